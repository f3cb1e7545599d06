"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from ranksmith.llm import chat, html_text, media, mixing, packing, quality, search, simhash, suffixes, toxicity

LONG = "lorem ipsum dolor sit amet " * 40_000
DOC = "doc_id long, text string, source string, score double, bucket long, part string, doc long, spans string"
ROWS = [
    (1, "alpha beta gamma delta epsilon", "a", 0.1, 1, "x", 1, "s"),
    (2, None, None, None, None, None, None, None),
    (3, "", "a", 0.1, 1, "x", 1, "s"),
    (4, LONG, "b", 0.1, 1, "x", 1, "s"),
    (5, "alpha beta gamma delta epsilon", "b", 0.1, 1, "x", 1, "s"),
    (6, " \t\n", "b", 0.1, 1, "x", 1, "s"),
    (6, " \t\n", "b", 0.1, 1, "x", 1, "s"),
    (None, "one word", None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


ALL = sorted((r[0] is None, r[0] or 0) for r in ROWS)


def test_quality(spark, docs, empty, labels):
    out = quality.score_quality(docs, labels)
    assert ids(out) == ALL and all(0 <= r.quality_score <= 1 for r in out.collect())
    assert quality.score_quality(empty, labels).count() == 0
    assert quality.score_quality(docs, labels.limit(0)).first().quality_score == 0.5


def test_toxicity(spark, docs, empty, labels):
    out = toxicity.score_toxicity(docs, labels)
    assert ids(out) == ALL and all(0 <= r.toxicity_score <= 1 for r in out.collect())
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == ALL
    assert all(0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    assert mixing.mix(empty).count() == 0


def test_simhash(docs, empty):
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    assert got[1].component_id == got[5].component_id == 1
    assert got[2].fingerprint == got[3].fingerprint == got[6].fingerprint == "0" * 16 and got[6].component_id == 2
    assert simhash.simhash_components(docs).count() == len(ROWS) and simhash.simhash_components(empty).count() == 0
    groups = {r.doc_id: r.group_id for r in simhash.near_copy_groups(docs).where("doc_id is not null").collect()}
    assert groups == {1: 1, 4: 4, 5: 1}


def test_suffixes(docs, empty):
    got = {r.doc_id: r.repeat for r in suffixes.remove_repeats(docs).collect()}
    assert got[2].n_bytes == 0 and got[1].n_removed == 0 and got[4].n_bytes == len(LONG)
    assert got[4].n_spans == 1 and len(got[4].kept) == 27  # all but the first period is covered by earlier starts
    assert suffixes.remove_repeats(docs).count() == len(ROWS) and suffixes.remove_repeats(empty).count() == 0


def test_packing(docs, empty):
    path = packing.tokenizer_path()
    got = packing.pack(docs, path).collect()
    assert sorted({(r.doc_id is None, r.doc_id or 0) for r in got}) == sorted(set(ALL))
    assert all(1 <= r.length <= 4096 for r in got) and max(r.piece for r in got if r.doc_id == 4) > 10
    assert packing.pack(empty, path).count() == 0


def test_search(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (7, [1.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(v, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 50, 65536), (0, 3, 5, 32768), (50, 1, 0, 65536), (50, 2, 1, 65536), (50, 3, 5, 32768)]
    assert search.top_k(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    common = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)] + [(60, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = {}
    for r in search.top_k(common, F.col("vec_id") % 20 == 0, tree_rows=8, query_rows=2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert {q: [v[k] for k in range(1, 6)] for q, v in got.items()} == {0: [60, 1, 2, 3, 4], 20: [60, 0, 1, 2, 3], 40: [60, 0, 1, 2, 3], 60: [0, 1, 2, 3, 4]}


def test_search_repeats_crowd_out_nothing(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.0])] * 6 + [(i, [1.0 / i, 0.0]) for i in range(2, 10)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = [r.vec_id for r in search.top_k(v, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5]


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, key string, at int"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (None, 0, "user", "x")]
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], schema)
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render_chats(turns).collect()}
    assert sorted(got) == [1, 4, 5]
    assert got[1] == (2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>")
    assert got[4] == (1, "<|im_start|>\n<|im_end|>") and got[5][0] == 2
    assert chat.render_chats(turns.limit(0)).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<b>x"), (4, "<div>" * 5000 + "deep")], "page_id long, html string").withColumn("text", F.lit("own"))
    got = {r.page_id: r.page_text for r in html_text.extract_pages(pages).collect()}
    assert got == {1: "", 2: "", 3: "x", 4: "deep"}
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_media(spark, docs):
    out = docs.select("doc_id", media.encode_text(F.col("text")).alias("content")).select("doc_id", media.media_digest(F.col("content"), F.lit(media.UNKNOWN)).alias("d"))
    assert ids(out) == ALL
    got = {r.doc_id: r.d for r in out.collect()}
    assert got[2].payload_bytes == got[3].payload_bytes == 576 and got[1].media_sha256 == got[5].media_sha256
    blobs = spark.createDataFrame([(1, None, None), (2, bytearray(b""), "x"), (3, bytearray(b"RIFFnothing"), "audio/wav")], "id long, content binary, mime string")
    seen = {r.id: r.s for r in blobs.select("id", media.sniffed(F.col("content"), F.col("mime")).alias("s")).collect()}
    assert seen[1].mime == media.UNKNOWN and seen[2].mime == "x" and seen[3].segments == []


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long, copy string, times int, cut string, quality_score double, row string, size int, doc string, tie string, taken string, label string"


def pipeline_rows():
    body = "the quick brown fox jumps over the lazy dog and then sleeps all day long in the warm sun by the old barn " * 2
    rows = [(1, body + "one"), (2, body + "one"), (2, "a different text of the same id"), (None, body + "one"), (None, "a text without an id"), (None, "another text without an id"), (None, None), (3, None), (4, ""), (5, LONG), (6, "twice"), (6, "twice")]
    return [(i, t, "en", "s", len(t or ""), "own copy", 7, "own cut", 0.25, "own row", 8, "own doc", "own tie", "own taken", "own label") for i, t in rows]


OWN = ("own copy", 7, "own cut", 0.25, "own row", 8, "own doc", "own tie", "own taken", "own label")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Labels for the first stage."""
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def kept(df):
    rows = df.collect()
    assert all(tuple(r)[5:] == OWN and r.lang == "en" for r in rows)
    return sorted((r.doc_id or 99, r.text or "") for r in rows)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.createDataFrame(pipeline_rows(), PIPELINE)
    every = sorted((r[0] or 99, r[1] or "") for r in pipeline_rows())
    assert set(kept(cp.keep_good(spark, docs, sf_dir))) <= set(every)
    near = kept(cp.drop_near_copies(spark, docs, sf_dir))
    body = pipeline_rows()[0][1]
    assert near == sorted(r for r in every if r[1] != body or r[0] == 1)  # copies go, a null id's other texts stay
    cut = kept(cp.cut_repeats(spark, docs, sf_dir))
    assert len(cut) == len(every) and (1, body) not in cut  # the first text repeats its own sentence
    assert {r for r in every if len(r[1]) < 100} <= set(cut)
    mixed = kept(cp.mix_sources(spark, docs, sf_dir))
    assert {r for r in mixed} == {r for r in every if r[1].strip()} and len(mixed) == len([r for r in every if r[1].strip()])
    packed = cp.pack_sequences(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in pipeline_rows()}


def test_pipeline_stages_on_an_empty_table(spark, sf_dir):
    import corpus_pipeline as cp

    empty = spark.createDataFrame([], PIPELINE)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_columns_are_never_replaced(spark, docs, labels):
    for call in (lambda: quality.score_quality(docs.withColumn("quality_score", F.lit(1)), labels), lambda: toxicity.score_toxicity(docs.withColumn("toxicity_score", F.lit(1)), labels), lambda: html_text.extract_pages(docs.withColumn("html", F.lit("x")).withColumn("page_text", F.lit(1)))):
        with pytest.raises(ValueError):
            call()
