"""Token alignment, bit-packed token files and the divergence of sources, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P

from ranksmith.llm import alignment as L
from ranksmith.llm import divergence as D
from ranksmith.llm import token_files as T

BYTE, PIECE, WORD = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "\n", "  a  b ", "a\n\nb", " \n x", "\x00 a\x00b \x00c", "<|endoftext|> <s> </s> <0x41> <unk>", "a\tb\r\n;\r c", "a b", "tab\x1cbed \x1c x",
    "lower▁one eighth", "ﬁne ２ é é", "中文字 日本 한국", "don't I'll we've 'sx", "word " * 3000, "x" * 20000, "same text", "same text", "é" * 5000 + " ab",
]
SCHEMA = "text string, doc_id long, DOC_ID_2 int, shard string, a int, n_ids string, lang string, source string, item string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(t, None if k % 7 == 3 else k // 2, k, "s", k, "n", [None, "en", "de"][k % 3], [None, "a", "B"][k % 2], "i") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    letters = L.byte_letters()
    vocab = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if all(c in letters for c in t)}
    return a, vocab, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def by_hand(text, tokenizers):
    """(ids of A, ids of B, groups, spans of A, spans of B) by one walk over both token lists; None without tokens."""
    a, vocab, b = tokenizers
    if not text:
        return None
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [vocab[i] for i in x]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    ends = [np.cumsum([len(t) for t in s]).tolist() for s in (bytes_a, bytes_b)]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append((list(range(i, p)), list(range(j, q))))
        i, j = p, q
    return x, y, groups, ends


def links_by_hand(found, mode):
    x, y, groups, (ends_a, ends_b) = found
    if mode == "end":
        return [(x[g[-1]], y[h[-1]]) for g, h in groups]
    if mode == "group":
        return [(x[i], y[j]) for g, h in groups for i in g for j in h]
    starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
    return [(x[i], y[j]) for g, h in groups for i in g for j in h if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]]


def expected_alignment(rows, tokenizers, mode):
    found = [by_hand(text, tokenizers) for text in rows]
    links = [links_by_hand(f, mode) if f else [] for f in found]
    count = Counter(pair for one in links for pair in one)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for f, one in zip(found, links, strict=True):
        text = ";".join(",".join(str(f[0][i]) for i in g) + "|" + ",".join(str(f[1][j]) for j in h) for g, h in f[2]) if f else ""
        sha = hashlib.sha256(text.encode()).hexdigest() if f else ""
        sizes = (len(f[0]), len(f[1]), len(f[2])) if f else (0, 0, 0)
        out.append((*sizes, len(one), sum(count[p] == best[p[1]] for p in one), sum(count[p] for p in one), sha))
    return out


@pytest.mark.parametrize("mode", L.MODES)
def test_alignment_of_odd_texts(odd, tokenizers, mode):
    docs, rows = odd
    if mode == "group":
        docs, rows = docs.where("length(text) < 15000"), [r for r in rows if r[0] is not None and len(r[0]) < 15000]
    want = sorted(zip([str(r[1]) for r in rows], expected_alignment([r[0] for r in rows], tokenizers, mode), strict=True))
    got = L.align_documents(docs, BYTE, PIECE, mode, shard_chars=300).collect()
    assert sorted((str(r[0]), (*r[1:5], *r[5:])) for r in got) == want


def test_alignment_of_mixed_signs(tokenizers):
    """Texts of blanks, breaks, quotes, letters and odd signs are cut as the whole text is, next to others in one call."""
    pick = random.Random(5)
    texts = ["".join(pick.choice(" \n abT'sé.,1中▁\x1c\tﬁ\x00") if k % 2 else pick.choice(" \n ab's.é1") for _ in range(pick.randint(1, 40))) for k in range(600)]
    aligned, places = L.Aligner(BYTE, PIECE), L.Places()
    numbers = [[places[k] for k in aligned.keys(t)] for t in texts]
    counts, groups, _, _, _, kept = aligned.align(list(places), "end")
    for text, n in zip(texts, numbers, strict=True):
        found = by_hand(text, tokenizers)
        assert all(kept[n]) == (found is not None)
        if found:
            assert counts[:3, n].sum(axis=1).tolist() == [len(found[0]), len(found[1]), len(found[2])]
            assert "".join(groups[k] for k in n)[:-1] == ";".join(",".join(str(found[0][i]) for i in g) + "|" + ",".join(str(found[1][j]) for j in h) for g, h in found[2])


def test_ranks_equal_the_tokenizer(tokenizers):
    aligned = L.Aligner(BYTE, PIECE)
    pick = random.Random(2)
    signs = [chr(c) for c in (*range(32, 127), 0xE9, 0xDF, 0x4E2D, 0x1F600, 0x301, 0x663, 0xAD)] + ["\n", " ", " ", "'s", "'ll"]
    for _ in range(300):
        text = "".join(pick.choice(signs) for _ in range(60))
        assert aligned.quick.encode_ordinary(text) == tokenizers[0].encode(text, add_special_tokens=False).ids


def test_alignment_of_no_rows(spark):
    assert L.align_documents(spark.createDataFrame([], SCHEMA), BYTE, PIECE).count() == 0
    with pytest.raises(ValueError):
        L.align_documents(spark.createDataFrame([], SCHEMA), BYTE, PIECE, "near")


def test_rows_of_a_shard_are_documents(spark):
    """What passes through Spark at once is a document, whatever a shard holds; a document names each of its pairs once."""
    pick = random.Random(9)
    texts = [" ".join(pick.choices(["one", "two", "three", "fourteen", "unhappily"], k=200)) for _ in range(100)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = L.shard_rows(docs, BYTE, PIECE, "end").collect()
    assert sorted(int(r.doc_id) for r in rows) == list(range(len(texts))) and len({r.shard for r in rows}) == 1
    (pairs,) = [r for r in rows if r.a is not None]
    assert max(len(r.link) for r in rows) <= 4 * len(pairs.a) < 4 * 200
    assert sum(pairs.n) == sum(r.n_links for r in rows) == sum(int(np.frombuffer(r.times, "<i8").sum()) for r in rows)


def test_worker_memory_of_a_shard(spark, monkeypatch):
    """Where nearly all words differ a shard is closed by its chunks, not its characters."""
    import tracemalloc

    import pandas as pd
    import pyspark

    class Docs:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            return run

    class Task:
        get = classmethod(lambda task: task)
        partitionId = classmethod(lambda task: 0)

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    pick = random.Random(10)
    batches = (pd.DataFrame({"doc_id": "1", "text": [" ".join(f"{pick.getrandbits(20):05x}" for _ in range(1000)) for _ in range(100)]}) for _ in range(4))
    L.aligner(BYTE, PIECE)
    tracemalloc.start()
    assert sum(len(rows) for rows in L.shard_rows(Docs(), BYTE, PIECE, "end")(batches)) == 400
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 170 << 20


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_bits_round_trip(bits):
    for n in (0, 1, 31, 32, 33, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64)
        data = T.pack_bits(ids, bits)
        assert len(data) == -(-n * bits // 8) and T.unpack_bits(data, n, bits).tolist() == ids.tolist()


def test_segment_ranges_open_their_blocks_only():
    ids = np.random.default_rng(1).integers(0, 1 << 17, 5000).astype("<u4")
    content = T.segment([7, None], [ids[:4000].tobytes(), ids[4000:].tobytes()], 17, block=64)
    seg = T.Segment(content)
    assert seg.doc_ids == [7, None] and seg.starts.tolist() == [0, 4000, 5000] and seg.ids().tolist() == ids.tolist()
    for a, b in ((0, 1), (63, 65), (4999, 5000), (100, 100), (4990, 9000)):
        assert seg.ids(a, b).tolist() == ids[a:b].tolist()
    torn = bytearray(content)
    torn[-17 * 8 - 20 :] = b""
    with pytest.raises(ValueError):
        T.Segment(bytes(torn))
    with pytest.raises(ValueError):
        T.segment([1], [np.array([8], "<u4").tobytes()], 3)


def test_token_files(odd, spark, tmp_path):
    from tokenizers import Tokenizer

    docs, rows = odd
    whole = Tokenizer.from_file(WORD)
    T.write_tokens(docs, WORD, f"{tmp_path}/ids", segment_ids=500)
    got = T.read_documents(spark, f"{tmp_path}/ids").collect()
    want = Counter()
    for text, doc, *_ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in got][len(known) :] == [None] * (len(rows) - len(known))
    last = got[-1].start + got[-1].n_tokens
    part = {r.place: r.id for r in T.read_ids(spark, f"{tmp_path}/ids", last - 700, 650).collect()}
    assert sorted(part) == list(range(last - 700, last - 50))
    for r in got:
        if last - 700 <= r.start and r.start + r.n_tokens <= last - 50:
            assert zlib.crc32(np.array([part[r.start + k] for k in range(r.n_tokens)], "<u4").tobytes()) == r.ids_crc32
    T.write_tokens(spark.createDataFrame([], SCHEMA), WORD, f"{tmp_path}/none")
    assert T.read_documents(spark, f"{tmp_path}/none").count() == 0 and T.read_ids(spark, f"{tmp_path}/none", 0, 5).count() == 0


def test_chunk_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    whole, enc = Tokenizer.from_file(WORD), T.ChunkEncoder(WORD)
    pick = random.Random(3)
    texts = [t for t in ODD if t] + ["".join(pick.choice(" \n\tabZé'sÉ.,1<|中") for _ in range(50)) for _ in range(500)] + ["<|ENDOFTEXT|> a <|startoftext|>b"]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def divergence_by_hand(rows, min_docs, top):
    found = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in found}:
        docs = [x for x in found if x[0] == lang]
        held = Counter(t for _, _, ts in docs for t in set(ts))
        kept = sorted((t for t in held if held[t] >= min_docs), key=str.encode)
        counts = {s: Counter(t for _, s2, ts in docs if s2 == s for t in ts) for s in {x[1] for x in docs}}
        counts[None] = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept} for s, c in counts.items()}
        for s in counts:
            if s is None:
                continue
            pairs = [(r, sum((p[s][t] - p[r][t]) ** 2 // p[r][t] for t in kept)) for r in counts if r not in (None, s)]
            marks = [(t, (p[s][t] - p[None][t]) ** 2 // p[None][t]) for t in kept if counts[s][t] > 0 and p[s][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", marks)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, f, k) for k, (item, f) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    pick = random.Random(4)
    words = ["a", "ab", "abc", "abd", "b", "É", "é", "中文", "中", "zz", "Zz", "x" * 300, "x" * 299, "ß", "k9k", "under_score"]
    rows = [(" ".join(pick.choice(words) + pick.choice(["", ".", "-1"]) for _ in range(pick.randint(0, 30))), pick.choice([None, "en", "de", ""]), pick.choice([None, "s1", "S1", "é", "s2"])) for _ in range(150)]
    rows += [(None, "xx", "only"), ("", "yy", "p"), ("rare words here", "yy", "q")]
    monkeypatch.setattr(D, "RUN_LEAVES", 3)
    monkeypatch.setattr(D, "RANGE_BYTES", 400)
    monkeypatch.setattr(D, "ENTRIES", 40)
    monkeypatch.setattr(D, "BLOCK", 12)
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "text string, lang string, source string, item string, value int").repartition(3)
    got = D.source_divergence(docs, top=4).collect()
    assert sorted(tuple(r) for r in got) == divergence_by_hand(rows, 3, 4)
    assert D.source_divergence(docs.limit(0)).count() == 0


def test_trie_merges_and_walks_in_byte_order():
    pick = random.Random(6)
    words = [bytes(pick.choice(b"ab\xc3\xff") for _ in range(pick.randint(1, 8))) for _ in range(2000)]
    halves = [D.Trie(), D.Trie()]
    for k, w in enumerate(words):
        halves[k % 2].merge([(0, w, 1, {"s": k % 3 + 1})])
    halves[0].merge(halves[1].walk())
    term, got = b"", []
    for shared, suffix, docs, counts in halves[0].walk():
        assert not got or term[:shared] + suffix > term
        term = term[:shared] + suffix
        got.append((term, docs, counts["s"]))
    n, s = Counter(words), Counter()
    for k, w in enumerate(words):
        s[w] += k % 3 + 1
    assert got == [(w, n[w], s[w]) for w in sorted(n)]


def test_shares_beyond_64_bits():
    counts = np.array([0, 9_500_000_000, 3 * 10**12])
    assert D.share(counts, 10**13, 77).tolist() == [1 + 10**9 * (int(c) + 1) // (10**13 + 77) for c in counts]


def test_long_chain_of_terms():
    """Nested terms make a path of thousands of nodes; nothing recurses."""
    trie = D.Trie()
    trie.merge((0, b"x" * n, 1, {"s": 1}) for n in range(1, 4000))
    assert sum(1 for _ in trie.walk()) == 3999


def test_pieces_are_encoded_by_chunks():
    """Packing looks a chunk of white-space-free text up once, as the token files do."""
    from ranksmith.llm import packing

    assert "chunk_encoder" in packing.pieces.__code__.co_varnames + packing.pieces.__code__.co_cellvars and not hasattr(packing, "word_encoder")


def test_partitions_write_tries_without_nodes(monkeypatch):
    """A partition's walk comes from its sorted terms, equal to that of a trie; entries are added up before they count as too many."""
    import pandas as pd

    class Docs:
        def mapInPandas(self, run, schema):
            return run

    pick = random.Random(8)
    words = ["a", "ab", "abc", "b", "é", "É", "中文", "中", "x" * 300, "x" * 299 + "y", *("w" + "abc"[k % 3] * k for k in range(1, 40))]
    rows = [(pick.choice(["en", "de", ""]), pick.choice(["s", "t", ""]), " ".join(pick.choices(words, k=pick.randint(0, 20))).encode()) for _ in range(300)]
    rows += [("none", "s", b""), ("en", "u", b"1 2 3"), ("en", "t", b"long " * 500)]
    leaves = {}
    for lang, source, text in rows:
        for term in D.terms(text):
            leaves.setdefault((lang, term), [0, Counter()])[1][source] += 1
        for term in set(D.terms(text)):
            leaves[lang, term][0] += 1
    want = {}
    for lang in {lang for lang, _ in leaves}:
        trie = D.Trie()
        trie.merge((0, term, docs, dict(n)) for (of, term), (docs, n) in leaves.items() if of == lang)
        want[lang] = list(trie.walk())

    def fails(*_):
        raise AssertionError("a partition makes no nodes")

    batches = [pd.DataFrame(rows[i : i + 50], columns=["lang", "source", "text"]) for i in range(0, len(rows), 50)]
    different = sum(len(n) for _, n in leaves.values())
    for entries, text_bytes in ((1 << 20, 4 << 20), (different, 200), (20, 200)):
        monkeypatch.setattr(D, "ENTRIES", entries)
        monkeypatch.setattr(D, "TEXT_BYTES", text_bytes, raising=False)
        monkeypatch.setattr(D, "RUN_LEAVES", 7)
        with monkeypatch.context() as m:
            m.setattr(D.Trie, "merge", fails)
            out = pd.concat(list(D.partial_tries(Docs())(iter(batches))))
        assert out["size"].tolist() == [len(b) for b in out["body"]]
        tries, written = {}, Counter(zip(out["lang"], out["first"], strict=True))
        for lang, first, last, body in zip(out["lang"], out["first"], out["last"], out["body"], strict=True):
            run, term = list(D.unpacked(body)), b""
            for shared, suffix, *_ in run:
                term = term[:shared] + suffix
            assert run[0][:2] == (0, first) and term == last and len(run) <= 7
            tries.setdefault(lang, D.Trie()).merge(run)
        assert {lang: list(t.walk()) for lang, t in tries.items()} == want
        assert (max(written.values()) > 1) == (entries == 20)
