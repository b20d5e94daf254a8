"""Each operator against brute force on small fixtures, and on nulls, empty, repeated and odd rows."""

import collections
import random
import zlib
from array import array

import numpy as np
import pytest
import xxhash

from fieldcast.llm import common, html_text, licenses, packing, quality_classifier, quality_rules, simhash, url_filter, vectors, warc, wfst

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


def docs(spark, texts, ids=None, extra=False):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, DOC)
    if extra:  # names that the operators use inside
        for c in ("id", "t", "fp", "host", "h", "salt", "length", "piece", "component", "lines"):
            df = df.selectExpr("*", f"1 AS {c}")
    return df


def labels_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- shared


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame([*links, *links, (None, 3)], "a long, b long")).collect()}
    want = labels_of({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in links)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 SimHash


def plain_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    texts = base + [b.replace("w1 ", "w2 ", 1) for b in base] + [base[0].upper(), None, "", " \n", "one", "One two", "two  words"]
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs(spark, texts, extra=True)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == labels_of(fps, links)
    assert links


@pytest.mark.parametrize("leaf", [4, 10_000])
def test_trie_join_of_dense_groups(spark, leaf):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4) for _ in range(60)}
    fps = sorted(near | {rng.getrandbits(64) for _ in range(100)})
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed + [None]], "fp long")
    got = {r["node"]: r["component"] for r in common.connected_components(simhash.near_forest(df, 2, leaf)).collect()}
    links = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = labels_of(signed, links)
    assert {f: got.get(f, f) for f in signed} == want


def test_majority_of_long_texts():
    rng = np.random.default_rng(0)
    sizes = np.array([0, 1, 2, 255, 256, 1000])
    h = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, sizes.sum(), dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    got = simhash.majority_bits(h, starts, sizes)
    for s, n, g in zip(starts, sizes, got):
        part = h[s : s + n]
        assert int(g) == sum(1 << b for b in range(64) if 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > n)


# ---- 2 HTML


def test_main_text():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>A</a></li></ul></nav>"
        "<header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><!-- ad --><div class=\"ad\">Buy now</div>"
        "<article><h1>Head &amp; line</h1><p><b>One two three</b>four.<br><p>Five<br>six &lt;x&gt; &nbsp; y</p><aside>side</aside><form><label>Name</label></form><p>Tiny.</p></article>"
        "<section id='comments'><p>I like it the of and to in a is that it for was on are as with his they be</p></section><footer>&copy; us</footer>"
    )
    assert html_text.main_text(page) == "Head & line One two threefour. Five six <x> y Tiny."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<p>cut <b") == "cut"


def test_two_passes():
    long = "The cat sat on the mat and it was the best of all that the cat had for a long time in the house."
    page = f"<div id=menu><p>{long}</p></div><p>Short before</p><p>{long}</p><p>Short after</p><p><a href=1>all of it is a link here</a></p><p>Between</p><div class=footer><p>foot</p></div>"
    assert html_text.main_text(page).startswith("Short before The cat")
    assert "foot" not in html_text.main_text(page) and "link" not in html_text.main_text(page)


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>a</p></article>", 0), (1, "u", "<article><p>a</p></article>", 0), (2, None, None, 0), (None, "v", "", 0)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]


# ---- 3 WARC


def test_warc_round_trip(spark, tmp_path):
    body = "é" * 70_000 + "\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "http://a/", body), (2, "http://b/", body), (3, "http://c/\r\nX: y", None), (4, None, ""), (5, "http://d/", "x")]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w")).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    import base64
    import hashlib

    for i, _, h in rows:
        b = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
    only = spark.read.format("warc").load(str(tmp_path / "w")).filter("record_type = 'response' and target_uri like 'http://%'")
    assert sorted(bytes(r["payload"]).decode() for r in only.collect()) == sorted([body, "x"])
    heads = spark.read.format("warc").schema("record_id string, record_type string").load(str(tmp_path / "w"))
    assert heads.count() == 5
    big = warc.to_records(spark.createDataFrame(rows, "page_id long, url string, html string"), min_bytes=10)
    assert big.filter("record_type = 'revisit'").count() == 1
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e")).count() == 0


def test_warc_filters_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StructType

    r = warc.WarcReader("/none", StructType.fromDDL("record_type string"))
    left = list(r.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert len(left) == 1 and len(r.tests) == 1
    assert not r._wanted({"record_type": "response"}) and r._wanted({"record_type": "revisit"})


# ---- 4 licences


def test_license_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "words here\n" + apache + "\n" + "more of the text " * 30, "src/a/x.txt"),
        (2, apache, "src/LICENSE"),
        (3, "no notice of any kind", "src/a/b/y.txt"),
        (4, "This work is licensed under the GNU General Public License, version 3.", "src/a/b/COPYING"),
        (5, None, "src/a/b/c/z"),
        (6, "", "other/z"),
        (7, "mit der Zeit, the license of the house", None),
        (8, "Intro. Released under the MIT License. The end is near and more words follow in this line for long.", "other/q/w"),
    ]
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {
        1: ("Apache-2.0", "header", None),
        2: ("Apache-2.0", "file", None),
        3: ("GPL-3.0", "inherited", "src/a/b"),
        4: ("GPL-3.0", "file", None),
        5: ("GPL-3.0", "inherited", "src/a/b"),
        6: (None, None, None),
        7: (None, None, None),
        8: ("MIT", "file", None),
    }


# ---- 5 quality classifier


def _graded(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(30, 200))
        g = rng.choice([0, 1, 2, 2, 2])
        if g == 0:
            for _ in range(rng.randint(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(["scoundrel", "villain"])
        if g == 1:
            w = [x.upper() + "!!" for x in w]
        out.append((i, " ".join(w), g))
    return out


def test_classifier_held_out(spark):
    rows = _graded(900, 4)
    d = docs(spark, [t for _, t, _ in rows] + [None, " "])
    graded = spark.createDataFrame([(i, g) for i, _, g in rows if i < 600] + [(None, 1), (3, None)], "doc_id long, grade int")
    model = quality_classifier.train(d, graded)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in quality_classifier.score(d, model).collect()}
    held = [(got[i], g) for i, _, g in rows if i >= 600]
    assert np.mean([r["kept"] == (g == 2) for r, g in held]) > 0.97
    assert not got[900]["kept"] and not got[901]["kept"]
    assert all(0 <= r["p_top"] <= r["expected_grade"] <= 2 for r in got.values())
    kept = quality_classifier.keep_good(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_classifier_without_labels(spark):
    d = docs(spark, ["a b", None])
    model = quality_classifier.train(d, spark.createDataFrame([], "doc_id long, grade int"))
    assert quality_classifier.score(d, model).count() == 2


# ---- 6 vectors


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 16))
    near = np.concatenate([base[:40] + 0.05 * rng.standard_normal((40, 16)), base[0] + 0.08 * rng.standard_normal((60, 16)), base[:5], base[:5]])
    every = np.concatenate([base, near]).astype(np.float32)
    lab = [i % 3 if i < 300 else (0 if 340 <= i < 400 else (i - 300) % 3 if i < 340 else (i - 400) % 5 % 3) for i in range(len(every))]
    rows = [(i, v.tolist(), lab[i]) for i, v in enumerate(every)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, rows[0][1], None), (n + 4, [None, *rows[0][1][1:]], 0), (n + 5, [1.0, 2.0], 0), (n + 6, [1.0, 2.0], 0)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    s = unit @ unit.T
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if lab[i] == lab[j] and s[i, j] >= 0.98] + [(n + 5, n + 6)]
    deg = collections.Counter(x for p in links for x in p)
    want = labels_of(range(n + 7), links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: deg[i] for i in range(n + 7)}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


# ---- 7 packing


def test_plan_is_best_fit():
    import bisect

    rng = random.Random(7)
    for _ in range(60):
        cap = rng.choice([8, 64, 4096])
        counts = {rng.randint(1, cap): rng.randint(1, 200) for _ in range(rng.randint(1, 30))}
        seqs, ranks = collections.defaultdict(list), collections.defaultdict(list)
        for length, first, n, per, seq, at in packing.plan_slots(counts, cap):
            for k in range(n):
                seqs[seq + k // per].append((at + k % per * length, length))
                ranks[length].append(first + k)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for v in seqs.values():
            end = 0
            for at, length in sorted(v):
                assert at == end
                end += length
            assert end <= cap
        rooms, made = [], 0
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                i = bisect.bisect_left(rooms, length)
                room = rooms.pop(i) if i < len(rooms) else cap
                made += room == cap and i >= len(rooms)
                bisect.insort(rooms, room - length)
                rooms = rooms[bisect.bisect_left(rooms, 1) :]
        assert len(seqs) <= made + 1


def test_pack(spark):
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    texts = ["hello World", None, "", "a " * 9000, "Ünï 漢字 ½ <|endoftext|> it's", "hello World", "x" * 3000]
    got = packing.pack(docs(spark, texts, ids=[0, 1, 2, 3, 4, 0, 6], extra=True), path).collect()
    t = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, x in zip([0, 1, 2, 3, 4, 0, 6], texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = array("I", ids[at : at + 4096])
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= 4096
    assert packing.pack(docs(spark, []), path).count() == 0


# ---- 8 URLs


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    rest = rest[:cut]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = slash + path
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    rng = random.Random(9)
    names = ["com", "net", "example.com", "www.example.com", "a.example.com", "example.net", "ample.com", "xn.com", ""]
    urls = [f"{s}{h}{p}{q}" for s in ("http://", "https://", "") for h in names + ["EXAMPLE.com", "é.com"] for p in ("", "/", "/en/", "/en/x", "/es/1", "/e") for q in ("", "?a=/en/", "#x")] + [None, "", "://", "http://com?x://y/"]
    rules = url_filter.RULES + [(rng.choice(names[:-1]), rng.choice(["", "/", "/e", "/en/x", "/es/"]), rng.choice(["allow", "block"])) for _ in range(12)]
    seen = {}
    for h, p, v in rules:
        seen[h, p] = max(v, seen.get((h, p), ""))
    rules = [(h, p, v) for (h, p), v in seen.items()]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, path int")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, table).collect()}
    for i, u in enumerate(urls):
        assert got[i] == plain_verdict(u, rules), u
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0
    assert url_filter.judge_urls(pages, table.limit(0)).filter("rule is not null").count() == 0


# ---- 9 SentencePiece


def test_transducer_agrees_with_the_library(spark):
    path = vocabulary("piece_bpe_32k.model")
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = [None, "", " ", "  a  b ", "漢字 é\n\tx", "▁a ▁▁b", "<s> <unk>", "🙂🙂x", "e" * 500, "The quick brown fox"] + ["".join(rng.choices("abcdeé ,.\n漢", k=60)) for _ in range(40)]
    got = {r["doc_id"]: r for r in wfst.round_trip(docs(spark, texts), path).collect()}
    for i, x in enumerate(texts):
        ids = array("I", sp.encode(x or "")).tobytes()
        assert (got[i]["n_ids"], got[i]["ids_crc32"]) == (len(ids) // 4, zlib.crc32(ids)), x
    assert all(got[i]["same"] for i, x in enumerate(texts) if x is None or "▁" not in x)
    encoded = wfst.encode_documents(docs(spark, texts), path)
    back = {r["doc_id"]: r["text"] for r in wfst.decode_documents(encoded, path).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(texts) if x is None or "▁" not in x)


# ---- 10 quality rules


def plain_counts(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    win = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    rng = random.Random(11)
    texts = [None, "", " \n\t", "a b c a b c", "x\ny\nx\n \nx", "#*$%&|<> é漢", "a\x0bb\fc\rd", "a a a a", "one", "\u00a0 b\u2003c"] + [" ".join(rng.choices("abcde", k=rng.randint(1, 90))) for _ in range(40)] + ["\n".join(" ".join(rng.choices(["Ab", "ab", "c"], k=3)) for _ in range(30))]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, texts, extra=True).drop("h", "host")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(t), repr(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_line_frequency(spark):
    rng = random.Random(12)
    fresh = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    note = "Share this notice with all of your friends and family today please"
    texts = [f"{fresh()}\n{note}" for _ in range(30)]  # boilerplate under different texts
    story = fresh()
    texts += [f"{story}\nSame second line here"] * 40  # copies: one document
    texts += ["\n".join([note.upper()] * 5 + [" ".join(f"q{i}" for i in range(50))])]  # half of it is the notice
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, texts)).collect()}
    assert all(got[i]["kept"] and got[i]["words_left"] == 60 for i in range(30))
    assert all(got[i]["kept"] and got[i]["words_left"] == 64 for i in range(30, 70))
    assert got[70]["words_left"] == 50 and not got[70]["base_failed"] is None
    kept = {r["doc_id"]: r["text"] for r in quality_rules.keep_good(docs(spark, texts)).collect()}
    assert kept[0] == texts[0].split("\n")[0] and kept[30] == texts[30]


def test_no_python_in_the_rules(spark):
    plan = quality_rules.quality_rules(docs(spark, ["a b c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_on_an_empty_table(spark):
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0
    assert quality_rules.keep_good(docs(spark, [])).count() == 0
