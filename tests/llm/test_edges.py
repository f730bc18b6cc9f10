"""Every operator and pipeline stage on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from boxwright.llm.bpe import bpe_decode, bpe_digest, bpe_encode
from boxwright.llm.fingerprint import edited, fingerprints, near_pairs
from boxwright.llm.license_scan import license_scan
from boxwright.llm.line_dedup import line_dedup
from boxwright.llm.mixing import mixed
from boxwright.llm.ngram_join import ngram_dedup, ngram_join
from boxwright.llm.quality import quality_rules
from boxwright.llm.substring_dedup import substring_dedup
from boxwright.llm.toxicity import fit, score, toxicity_filter
from boxwright.llm.url_filter import domain_suffix, url_filter

CLASHES = ("n_lines", "n_dropped", "n_words", "n_removed", "ids", "score", "kept", "fingerprint", "class_id", "taken", "_score", "block", "epoch", "node", "license")


def labels(docs):
    return docs.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))


OPERATORS = {
    "bpe": lambda d: bpe_decode(bpe_encode(d)),
    "bpe digest": bpe_digest,
    "substring dedup": substring_dedup,
    "quality": quality_rules,
    "fingerprints": fingerprints,
    "near pairs": lambda d: near_pairs(fingerprints(d)),
    "edited": edited,
    "score": lambda d: score(d, fit(d, labels(d))),
    "toxicity filter": lambda d: toxicity_filter(d, labels(d)),
    "mixed": mixed,
    "line dedup": line_dedup,
    "ngram join": ngram_join,
    "ngram dedup": ngram_dedup,
    "license scan": license_scan,
}
ROW_FOR_ROW = ("bpe", "bpe digest", "substring dedup", "quality", "fingerprints", "edited", "score", "line dedup", "ngram join")


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(name, hard):
    n = OPERATORS[name](hard).count()
    if name in ROW_FOR_ROW:
        assert n == hard.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(name, hard):
    more = hard.withColumns({c: F.lit("own") for c in CLASHES})
    out = OPERATORS[name](more)
    assert len(set(out.columns)) == len(out.columns)
    out.collect()


def test_url_filter_edges(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Example.ORG"), (None, "x://h/p"), (1, None), (5, "http://u@h.co.uk:80?q#f")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good double")
    rows = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, none).collect()}
    assert (4, "a.example.org", "", None, "allow") in rows and (5, "u@h.co.uk:80", "", None, "allow") in rows and (1, "", "", None, "allow") in rows
    assert url_filter(pages, none).count() == 7
    assert url_filter(pages.limit(0), none).count() == 0
    more = url_filter(pages.withColumns({c: F.lit("own") for c in ("host", "path", "rule", "verdict", "n", "good")}), spark.createDataFrame([(1, 1.0), (1, 0.0), (4, None), (None, 1.0)], "page_id long, good double"))
    assert more.columns == ["page_id", "host", "path", "rule", "verdict"] and more.count() == 7


def test_domains_of_ports_and_addresses(spark):
    hosts = ["a.b.com", "a.b.com:8080", "u:p@a.b.co.uk:1", "10.0.0.1", "10.0.0.1:80", "[::1]:443", "b", "", "h.org:"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *[c.alias(n) for c, n in zip(domain_suffix(F.col("host")), ("d", "s"))])
    assert {r.host: (r.d, r.s) for r in rows.collect()} == {
        "a.b.com": ("b.com", "com"), "a.b.com:8080": ("b.com", "com"), "u:p@a.b.co.uk:1": ("b.co.uk", "co.uk"), "10.0.0.1": ("10.0.0.1",) * 2,
        "10.0.0.1:80": ("10.0.0.1",) * 2, "[::1]:443": ("[::1]",) * 2, "b": ("b", "b"), "": ("", ""), "h.org:": ("h.org", "org"),
    }


@pytest.mark.parametrize("rows", ["hard", "empty"])
def test_pipeline_stages(spark, rows, request, tmp_path):
    import corpus_pipeline

    docs = request.getfixturevalue(rows)
    labels(docs).withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.withColumn("_score", F.lit(1)).withColumn("ids", F.lit("x")), str(tmp_path))
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns, name
    assert "n_tokens" in docs.columns
