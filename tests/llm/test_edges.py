"""Nulls, empty and long texts, repeats, empty tables and clashing column names, for every operator and stage."""

import pytest

from semloom.llm import bpe, chat, hnsw, langid, packing, quality, secrets, simhash, urlrep, winnow

LONG = "the water of the river runs by the old mill and over the stones " * 4000
DDL = "ID string, doc_id bigint, TEXT string, text string, lang string, source string, n_chars bigint, _lid_ int, `_q_` int, x string, i int, key string"


def row(i, text, lang="en"):
    return ("clash", i, "other", text, lang, "s", len(text) if text is not None else None, 1, 2, "x", 3, "k")


@pytest.fixture(scope="module")
def docs(spark):
    plain = [row(i, f"the quick brown fox number {i} jumps over a lazy dog near the bank of river {i * 7}") for i in range(12)]
    odd = [row(20, None), row(21, ""), row(22, " \n\t "), row(23, "!!! ... ???"), row(24, LONG), row(None, "a text without an id"), row(None, None)]
    same = [row(30, "the same words twice in this very place"), row(31, "the same words twice in this very place"), row(30, "the same words twice in this very place")]
    return spark.createDataFrame(plain + odd + same, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, None), (24, 1, 0)], "doc_id bigint, quality int, toxic int")


def got(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_near_duplicates(docs, empty):
    r = got(simhash.near_duplicates(docs))
    assert None not in r and all(len(v) == 1 for v in r.values()) and len(r) == 19
    assert r[31][0].group_id == 30 and not r[31][0].keep and r[30][0].keep
    assert r[20][0].group_id == 20 and r[20][0].keep
    assert r[21][0].group_id == 21 and r[24][0].keep
    assert simhash.near_duplicates(empty).count() == 0


def test_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.9, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("1 as ID", "vec_id", "embedding", "2 as shard", "3 as V")
    r = got(hnsw.neighbours(df, k=2), "vec_id")
    assert sorted(r) == [1, 2, 3]
    assert [(x["rank"], x.neighbour) for x in sorted(r[1], key=lambda x: x["rank"])] == [(1, 2), (2, 3)]  # a tie: the lesser id first
    assert hnsw.neighbours(df.limit(0)).count() == 0


def test_quality(docs, labels, empty):
    r = got(quality.quality(docs, labels, epochs=1))
    assert r[20][0].p_high is None and not r[20][0].keep and r[21][0].n_features == 0 and r[24][0].n_features > 100_000
    assert len(r[30]) == 2 and r[30][0] == r[30][1] and len(r[None]) == 2
    assert quality.quality(empty, labels).count() == 0
    none = got(quality.quality(docs, labels.limit(0)))
    assert none[1][0].p_high == 0.5 and none[1][0].keep


def test_secrets(docs, empty):
    assert secrets.secret_scan(docs).count() == 0 and secrets.secret_scan(empty).count() == 0


def test_secret_edges(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    df = spark.createDataFrame([(1, key, "x"), (1, key, "x"), (None, f"a {key}", "y"), (2, LONG + key, "z")], "doc_id bigint, text string, rule string")
    r = got(secrets.secret_scan(df))
    assert len(r[1]) == 2 and len(r[None]) == 1 and r[2][0].start == len(LONG) and r[2][0].end == len(LONG) + len(key)


def test_fingerprints(docs, empty):
    r = got(winnow.fingerprints(docs))
    assert r[20][0].hashes == r[21][0].hashes == r[23][0].hashes == [] and r[30][0].hashes == r[31][0].hashes and len(r[30]) == 2
    assert r[24][0].n > 1000 and len(r[None]) == 2
    assert winnow.fingerprints(empty).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi", 9), (1, 0, "user", "hi", 9), (1, 1, "assistant", "hello", 9), (1, None, "assistant", "late", 9), (1, 2, None, "who", 9), (1, 3, "user", None, 9), (None, 0, "user", "x", 9), (2, 0, "system", "", 9), (3, 0, "user", LONG, 9), (3, 1, "assistant", LONG, 9)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, `TEXT` int")
    r = got(chat.chat_windows(df), "conv_id")
    assert None not in r and len(r[1]) == 1 and len(r[2]) == 1
    assert r[1][0].n_targets == len(bpe.encoder().encode("hello")) + len(bpe.encoder().encode("late")) + 2
    assert r[2][0].first_turn is None and r[2][0].n_tokens == 2
    assert max(x.n_tokens for x in r[3]) <= chat.BUDGET and sum(x.n_targets for x in r[3]) == len(bpe.encoder().encode(LONG)) + 1
    assert chat.chat_windows(df.limit(0)).count() == 0


def test_bpe(docs, empty):
    r = got(bpe.encode(docs))
    assert r[20][0].tokens is None and r[20][0].n_tokens is None and r[21][0].tokens == []
    assert bpe.encoder().decode(r[24][0].tokens).decode() == LONG and len(r[30]) == 2 and len(r[None]) == 2
    assert bpe.encode(empty).count() == 0
    back = got(bpe.decode(bpe.encode(docs)))
    assert back[22][0].text == " \n\t " and back[20][0].text is None


def test_urls(spark, labels):
    rows = [(0, "http://a.com/x", 1), (0, "http://a.com/x", 1), (1, None, 1), (2, "", 1), (3, "nonsense", 1), (4, "HTTPS://User@B.co.uk:80/y", 1), (None, "http://a.com", 1), (5, "http://192.168.0.1/z", 1), (6, "http://a.com./" + "z" * 100_000, 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, HOST int")
    r = got(urlrep.url_filter(df, labels), "page_id")
    assert sum(map(len, r.values())) == len(rows) and len(r[0]) == 2 and r[0][0] == r[0][1]
    assert r[1][0].host is None and r[2][0].host is None and r[3][0].host is None and r[1][0].p_bad == r[3][0].p_bad
    assert (r[4][0].host, r[4][0].domain, r[4][0].suffix) == ("b.co.uk", "b.co.uk", "co.uk")
    assert (r[5][0].domain, r[6][0].host) == ("192.168.0.1", "a.com")
    assert urlrep.url_filter(df.limit(0), labels).count() == 0
    unlabelled = urlrep.url_filter(df, labels.limit(0)).collect()
    assert all(x.keep and x.p_bad == 0.5 for x in unlabelled)


def test_language(docs, empty):
    r = got(langid.language_id(docs))
    assert r[20][0].lang is None and not r[20][0].keep and not r[21][0].keep and not r[22][0].keep and r[24][0].n_bytes > 250_000
    assert len(r[30]) == 2 and r[30][0] == r[30][1] and len(r[None]) == 2
    assert langid.language_id(empty).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    ids = {r.doc_id for r in rows}
    assert 20 not in ids and 21 not in ids and None in ids
    assert {r.copy for r in rows if r.doc_id == 30} == {0, 1}
    assert sum(r.size for r in rows if r.doc_id == 24) == -(-len(LONG) // packing.TOKEN_BYTES)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("stage", [langid.filter_stage, quality.filter_stage, simhash.filter_stage, secrets.redact_stage])
def test_stages_keep_the_columns(stage, docs, empty, labels, tmp_path, spark):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    rows = out.collect()
    assert all(r[0] == "clash" and r[2] == "other" and r[11] == "k" for r in rows)
    ids = [r[1] for r in rows]
    if stage is simhash.filter_stage:
        assert ids.count(30) == 1 and 31 not in ids and ids.count(None) == 2 and 20 in ids and 24 in ids
    elif stage is secrets.redact_stage:
        assert len(rows) == docs.count()
    else:
        assert 20 not in ids and 21 not in ids
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pack_stage(docs, empty, spark):
    r = got(packing.pack_stage(spark, docs, ""))
    size = lambda i: sum(x.size for x in r[i])
    assert 20 not in r and 21 not in r and size(24) == len(bpe.encoder().encode(LONG)) and size(None) == len(bpe.encoder().encode("a text without an id"))
    assert {x.copy for x in r[30]} == {0, 1} and len(r[31]) == 1
    assert packing.pack_stage(spark, empty, "").count() == 0


def test_pipeline_edges(docs, empty, labels, tmp_path, spark):
    """Odd rows go through all stages; an empty table gives the same columns."""
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    sizes = []
    for name, d in ("odd", docs), ("empty", empty):
        kept = d.toDF(*[f"c{i}" if i in (0, 2, 7, 8, 9, 10, 11) else c for i, c in enumerate(d.columns)]).select(*columns)
        kept.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        sizes.append(out.count())
        ids = {r.doc_id for r in out.collect()}
        assert out.columns == ["bin_id", "slot", "offset", "doc_id", "copy", "start", "size", "fill"] and not ids & {20, 21, 22, 31}
    assert sizes[0] > 0 and sizes[1] == 0
