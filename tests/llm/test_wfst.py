"""The transducer: path search, normaliser maps, unigram and BPE models, user symbols, odd rows."""

import random
import struct
import zlib
from array import array

import pytest

from fieldcast.llm import wfst
from fieldcast.llm.merges import MergeLattice

spm = pytest.importorskip("sentencepiece")


def number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def part(field, value):
    """A field of a protocol-buffer message."""
    if isinstance(value, float):
        return number(field << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return number(field << 3) + number(value)
    return number(field << 3 | 2) + number(len(value)) + value


def model(pieces, kind, bytes_=False, users=(), normal=b"", dummy=1, squeeze=1):
    """Bytes of a model file. ``pieces``: text -> score."""
    every = [("<unk>", 0.0, wfst.UNKNOWN), ("<s>", 0.0, wfst.CONTROL), ("</s>", 0.0, wfst.CONTROL)]
    every += [(f"<0x{b:02X}>", 0.0, wfst.BYTE) for b in range(256)] if bytes_ else []
    every += [(u, 0.0, wfst.USER) for u in users] + [(p, float(s), wfst.NORMAL) for p, s in pieces.items()]
    out = b"".join(part(1, part(1, p.encode()) + part(2, s) + part(3, k)) for p, s, k in every)
    return out + part(2, part(3, kind) + part(35, int(bytes_))) + part(3, normal + part(3, dummy) + part(4, squeeze) + part(5, 1))


def charmap(rule):
    """Name and character map of the library's own normaliser."""
    fields = dict(wfst._fields(spm.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()))
    return part(1, fields[1]) + part(2, fields[2])


def agree(data, texts):
    t, lib = wfst.Transducer(data), spm.SentencePieceProcessor(model_proto=data)
    got = [array("I", x).tolist() for x in t.encode_all(texts)]
    for text, ids in zip(texts, got):
        assert ids == lib.encode(text), (text, ids, lib.encode(text, out_type=str))
    return t


def grown(rng, units, n):
    """Pieces that merging reaches: each the sum of two before it; later ones rank lower."""
    pieces = list(units)
    while len(pieces) < n:
        p = rng.choice(pieces) + rng.choice(pieces)
        if p not in pieces and len(p) < 9 and "▁" not in p[1:]:
            pieces.append(p)
    return {p: -i for i, p in enumerate(pieces)}


ODD = ["", " ", "  a  b ", "a\tb\nc", "漢字 é", "ﬁ　Ａ①", "é é̂x", "ab" * 300, "🙂🙂x", "aé漢", "½ ㍿ ﷺ a", "​z­ b", "(a) <b>", "KÅk"]


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_normaliser_maps(rule):
    rng = random.Random(1)
    t = wfst.Normaliser(dict(wfst._fields(charmap(rule) + part(3, 1) + part(4, 1) + part(5, 1))), None)
    lib = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    alphabet = "abAé́̂ ﬁ①Ａ　½\t\n漢ⅣßİΣ각x가 "
    for text in ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(200)]:
        assert t(text) == lib.normalize(text), text


@pytest.mark.parametrize("bytes_", [False, True])
@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc"])
@pytest.mark.parametrize("kind", [wfst.BPE, wfst.UNIGRAM])
def test_models_agree_with_the_library(kind, rule, bytes_):
    rng = random.Random(kind)
    pieces = grown(rng, "▁abcdé1fi", 60)
    if kind == wfst.UNIGRAM:
        pieces = {p: -rng.uniform(1, 9) - 0.3 * len(p) for p in pieces}
    texts = ODD + ["".join(rng.choices("abcdéA \n漢①", (8, 8, 8, 8, 2, 1, 6, 1, 1, 1), k=rng.randint(1, 80))) for _ in range(150)]
    for dummy, squeeze in ((1, 1), (0, 0)):
        agree(model(pieces, kind, bytes_, (), charmap(rule), dummy, squeeze), texts)


def test_user_symbols():
    rng = random.Random(6)
    texts = ["a<x>b", "<x><x>ab<xy>", "ab<x", "<x>", "a <x> b", "x"] + ["".join(rng.choices(["a", "b", "<x>", "<xy>", " ", "<"], k=20)) for _ in range(60)]
    agree(model(grown(rng, "▁ab<xy>", 30), wfst.BPE, True, ("<x>", "<xy>"), charmap("nmt_nfkc")), texts)


def test_what_is_refused():
    with pytest.raises(ValueError):
        wfst.Transducer(model({"a": 0}, 3))


def test_paths_equal_merging():
    rng = random.Random(0)
    pieces = grown(rng, "abc", 25)
    t = wfst.Transducer(model(pieces, wfst.BPE))
    lattice = MergeLattice(t.ids, lambda a, b: -pieces[a + b] if a + b in pieces else None)
    texts = sorted({"".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(500)})
    assert list(t.shortest_paths(texts)) == [lattice.greedy(x)[0] for x in texts]


def test_unigram_paths_are_the_cheapest():
    rng = random.Random(3)
    pieces = {p: -rng.randint(1, 9) for p in grown(rng, "abc", 20)}
    t = wfst.Transducer(model(pieces, wfst.UNIGRAM))

    def least(text):
        return 0.0 if not text else min(least(text[len(p) :]) - s for p, s in pieces.items() if text.startswith(p))

    texts = sorted("".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(100))
    for text, path in zip(texts, t.shortest_paths(texts)):
        assert "".join(path) == text and -sum(pieces[p] for p in path) == pytest.approx(least(text))


def test_every_new_word_is_searched():
    t = wfst.Transducer(model(grown(random.Random(2), "▁abc", 30), wfst.BPE, True))
    asked = []
    search = t.shortest_paths
    t.shortest_paths = lambda words: search([asked.append(w) or w for w in words])
    t.encode_all(["ab ca ab", "ca é"])
    t.encode_all(["ab " + "c" * 200])
    t.encode_all(["c" * 200])
    assert sorted(asked) == sorted(["▁ab", "▁ca", "▁é", "▁" + "c" * 200, "▁" + "c" * 200])  # long words are not kept
    # other weights give other ids: they come from the search alone
    fine = t.encode("abc")
    t.kept.clear()
    t._weight = lambda before, piece: 0.0 if len(piece) == 1 else float("inf")
    t.weights.clear()
    assert array("I", t.encode("abc")).tolist() == [t.ids[c] for c in "▁abc"] and t.encode("abc") != fine


def test_small_table_changes_nothing(monkeypatch):
    data = model(grown(random.Random(4), "▁abcd", 50), wfst.BPE, True)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcd", k=5)) for _ in range(30)) for _ in range(20)]
    want = wfst.Transducer(data).encode_all(texts)
    monkeypatch.setattr(wfst, "_CACHED", 40)
    monkeypatch.setattr(wfst, "_WEIGHTS", 10)
    small = wfst.Transducer(data)
    assert [small.encode_all([x])[0] for x in texts] == want and len(small.kept) <= 40 and len(small.weights) <= 10


def test_odd_rows(spark):
    """Repeated rows, null ids, other columns, a very long text without blanks, an empty table."""
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    lib = spm.SentencePieceProcessor(model_file=path)
    long = "".join(random.Random(1).choices("abcdefgh漢字", k=200_000))
    rows = [(1, "same"), (1, "same"), (None, "x y"), (2, long), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS t", "3 AS ids")
    got = sorted((r["doc_id"] or 0, r["n_ids"], r["ids_crc32"], r["n_decoded"], r["same"]) for r in wfst.round_trip(df, path).collect())
    ids = [(i or 0, array("I", lib.encode(x or "")).tobytes(), x or "") for i, x in rows]
    assert got == sorted((i, len(b) // 4, zlib.crc32(b), len(x), True) for i, b, x in ids)
    assert wfst.round_trip(df.limit(0), path).count() == 0 and wfst.decode_documents(wfst.encode_documents(df.limit(0), path), path).count() == 0
