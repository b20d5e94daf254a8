"""Templates of public licences: notices as authors write them, openings of the licences' own
texts, and short licences whole."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    #: The beginning of a licence's own text: a file that holds it is a licence file.
    title: bool = False
    #: Words that the whole file must hold, or must not.
    needs: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    #: A file that holds the first of these but none of the others is of another variant.
    other: tuple[str, tuple[str, ...]] | None = None


#: Licences by their identifiers, with the names that notices call them by.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"],
    "MIT": ["MIT License", "MIT license terms"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "two-clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "three-clause BSD license"],
    "ISC": ["ISC License"],
    "0BSD": ["Zero-Clause BSD License", "0BSD license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL version 2", "GPLv2", "GNU GPL v2", "GPL-2.0 license", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL version 3", "GPLv3", "GNU GPL v3", "GPL-3.0 license", "GNU General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1", "GNU LGPL v2.1", "LGPL-2.1 license"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3", "GNU LGPL v3", "LGPL-3.0 license"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3", "GNU AGPL v3", "AGPL-3.0 license"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0 license"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "EPL-2.0 license"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero 1.0", "CC0-1.0 license"],
}
PHRASES = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "License: {}"]

#: Parts of the attribution licences, their versions, and notices.
CC_PARTS = {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_KINDS = ["BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = {"4.0": "4.0 International", "3.0": "3.0 Unported", "2.0": "2.0 Generic"}
CC_PHRASES = ["Licensed under CC {kind} {version}.", "This work is licensed under a Creative Commons {long} {full} License.", "License: CC-{kind}-{version}"]

#: Notices and texts.
TEXTS = [
    Template("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    Template("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", title=True),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", title=True),
    Template("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', other=("furnished", ("subject", "substantial"))),
    Template("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', title=True, other=("furnished", ("subject", "substantial"))),
    Template("MIT-0", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.', title=True, needs=("furnished",), lacks=("subject", "substantial")),
    Template("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", title=True, needs=("neither", "endorse", "promote"), lacks=("mentioning",)),
    Template("BSD-4-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", title=True, needs=("neither", "endorse", "mentioning")),
    Template("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", title=True, lacks=("endorse",)),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", title=True, needs=("provided",)),
    Template("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", title=True, lacks=("provided",)),
    Template("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    Template("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    Template("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", title=True),
    Template("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", title=True),
    Template("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", title=True),
    Template("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", title=True),
    Template("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    Template("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", title=True),
    Template("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    Template("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", title=True),
    Template("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works.", title=True),
    Template("Apache-2.0", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.', title=True),
    Template("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", title=True),
    Template("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", title=True),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions", title=True),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    Template("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE", title=True),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    Template("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", title=True),
    Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", title=True),
    Template("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", title=True),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", title=True),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", title=True),
]


def _long(kind: str) -> str:
    return "-".join(["Attribution", *(CC_PARTS[p] for p in kind.split("-")[1:])])


def templates() -> list[Template]:
    """All templates: the texts, the phrases with every name, and identifier lines."""
    out = list(TEXTS)
    out += [Template(k, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES]
    out += [Template(k, f"SPDX-License-Identifier: {k}{tail}") for k in NAMES for tail in ("", *(("-only", "-or-later") if "GPL" in k else ()))]
    for kind in CC_KINDS:
        for version, full in CC_VERSIONS.items():
            name, say = f"CC-{kind}-{version}", {"kind": kind, "version": version, "long": _long(kind), "full": full}
            out += [Template(name, p.format(**say)) for p in CC_PHRASES] + [Template(name, f"SPDX-License-Identifier: {name}")]
        out.append(Template(f"CC-{kind}-4.0", f"Creative Commons {_long(kind)} 4.0 International Public License", title=True))
    return out
