"""Columns of the input that are named like those of a result, in any case: results stay defined and can be written."""

import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, divergence, linededup, pieces, pii, quality, secretscan, toxicity, urllists

TEXT = "Mr. Smith has a token = 'abcdefghij12' and writes to a.b@c.com about the shared passage of words"


def written(df, tmp_path):
    names = [c.lower() for c in df.columns]
    assert len(names) == len(set(names)), names
    df.write.parquet(str(tmp_path / "t"))
    return df.sparkSession.read.parquet(str(tmp_path / "t")).collect()


def docs(spark, *extra):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id bigint, text string").withColumns({c: F.lit("mine") for c in extra})


def test_quality(spark, tmp_path):
    rows = written(quality.judge(docs(spark, "N_Words", "_m", "KEPT", "other")), tmp_path)
    assert {r._m for r in rows} == {r.other for r in rows} == {"mine"} and {r.n_words for r in rows} == {0, 17}


def test_url_lists(spark, tmp_path):
    c = spark.createDataFrame([(1, "http://a.bad.org/x", 9)], "id int, url string, fetched_at int").withColumns({x: F.lit("mine") for x in ("Host", "LIST", "_known", "_now")})
    e = spark.createDataFrame([("l", "bad.org", "add", 1)], "list string, pattern string, action string, at int")
    (r,) = written(urllists.judge(c, e), tmp_path)
    assert (r.host, r.list, r._known, r._now) == ("a.bad.org", "l", "mine", "mine")
    long = spark.createDataFrame([(1, "http://" + "a." * 100 + "bad.org/" + "x" * 2_000_000, 9)], "id int, url string, fetched_at int")
    assert urllists.judge(long, e).first().id == 1


def test_toxicity(spark, tmp_path):
    d = docs(spark, "Score", "N_Tokens", "passage")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, toxic int")
    rows = written(toxicity.score(d, toxicity.fit(d, labels)), tmp_path)
    assert all(0 <= r.score <= 1 and r.passage == "mine" for r in rows)


@pytest.mark.parametrize("extra", ["Items", "N_HIT", "_items", "_th"])
def test_decontaminate(spark, tmp_path, extra):
    b = spark.createDataFrame([("i", "about the shared passage of words")], "item_id string, text string")
    rows = {r.doc_id: r for r in written(decontaminate.mark(docs(spark, extra), b), tmp_path)}
    assert rows[1].n_hit == 6 and rows[1]["items"] == ["i"]


def test_secrets_pii_pieces(spark, tmp_path):
    assert len(written(secretscan.scan(docs(spark, "Secrets")), tmp_path / "a")) == 3
    assert len(written(pii.anonymise(docs(spark, "N_Email", "_tries")), tmp_path / "b")) == 3
    coded = pieces.encode(docs(spark, "IDS"))
    assert len(written(pieces.decode(coded.withColumn("Decoded", F.lit(1))), tmp_path / "c")) == 3


def test_lines_and_audit(spark, tmp_path):
    out = written(linededup.dedup(docs(spark, "N_LINES", "_i", "places")), tmp_path)
    assert {r.n_lines_ for r in out} == {1} and {r.places for r in out} == {"mine"}
    audit = divergence.audit(docs(spark, "Lang", "SOURCE", "Value", "rank"), min_docs=1)
    assert audit.count() == 0  # one source alone is neither apart from others nor from its language
