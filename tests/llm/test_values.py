"""The results that the docstrings define for nulls, empty and long texts, ties and repeated rows."""

import hashlib

from boxwright.llm.bpe import bpe_decode, bpe_digest, bpe_encode
from boxwright.llm.fingerprint import edited, fingerprints
from boxwright.llm.license_scan import license_scan
from boxwright.llm.line_dedup import line_dedup
from boxwright.llm.mixing import mixed
from boxwright.llm.ngram_join import ngram_dedup, ngram_join
from boxwright.llm.substring_dedup import substring_dedup
from boxwright.llm.toxicity import fit, score
from pyspark.sql import functions as F

EMPTY = hashlib.sha256(b"").hexdigest()


def by_id(rows):
    """Rows of each doc_id in the order of their text (null first)."""
    out = {}
    for r in sorted(rows, key=str):
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_bpe(hard):
    both = bpe_decode(bpe_encode(hard)).collect()
    assert [(list(r.ids), r.decoded) for r in both if not (r.text or "").strip()] == [([], "")] * 4
    found = by_id(both)
    assert found[5][0] == found[5][1] and "<|endoftext|>" in found[10][0].decoded.split(" ")
    digest = by_id(bpe_digest(hard).collect())
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in (digest[3] + digest[4] + digest[8])} == {(0, EMPTY, EMPTY)}
    assert digest[6][0].n_tokens == len(found[6][0].ids) > 1000


def test_substring_dedup(hard):
    found = by_id(substring_dedup(hard).select("doc_id", "text", "n_words", "n_removed").collect())
    assert [(r.text, r.n_words, r.n_removed) for i in (3, 4, 8) for r in found[i]] == [("", 0, 0)] * 3
    assert [(r.text, r.n_words, r.n_removed) for i in (1, 2) for r in found[i]] == [("", 65, 65)] * 2
    assert sorted((r.text, r.n_words, r.n_removed) for r in found[None]) == [("", 0, 0), ("no id", 62, 60)]
    assert [r.n_removed for r in found[5]] == [0, 0] and (found[7][0].text, found[7][0].n_removed) == ("", 40_000)


def test_line_dedup(hard):
    found = by_id(line_dedup(hard).select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert [(r.text, r.n_lines, r.n_dropped) for i in (3, 4) for r in found[i]] == [("", 1, 0)] * 2
    assert (found[1][0].n_lines, found[1][0].n_dropped) == (2, 0) and (found[2][0].text, found[2][0].n_dropped) == ("", 2)
    assert (found[9][0].text, found[9][0].n_lines, found[9][0].n_dropped) == ("Licensed under the Apache License, Version 2.0.\n\n", 4, 1)
    assert [(r.n_lines, r.n_dropped) for r in found[5]] == [(1, 0)] * 2  # one document
    assert sorted((r.n_lines, r.n_dropped) for r in found[None]) == [(1, 0), (1, 0)]


def test_ngram_join(hard):
    found = by_id(ngram_join(hard).collect())
    as_set = lambda i: [(r.class_id, r.copy_id, r.n_links, r.n_text_links) for r in found[i]]
    assert as_set(3) == as_set(4) == as_set(8) == [(3, 3, 3, 0)]
    assert as_set(1) == as_set(2) == [(1, 1, 2, 1)]
    assert sorted(as_set(None), key=str) == [(1, None, 2, 1), (3, 3, 3, 0)]
    assert as_set(5) == [(5, 5, 1, 0)] * 2 and as_set(6) == [(6, 6, 0, 0)]
    assert sorted(r.doc_id for r in ngram_dedup(hard).collect()) == [1, 3, 5, 6, 7, 9, 10, 11]


def test_edited(hard):
    found = by_id(edited(hard).collect())
    assert [(r.n_chars, r.edited_text) for i in (3, 4) for r in found[i]] == [(0, "")] * 2
    last = "of of of of of of of of of of of of"
    assert found[11][0].edited_text == last[: len(last) - len(last) // 2]  # the next is the first: a null id's empty text
    first, second = sorted(found[None], key=lambda r: r.n_chars)
    assert first.edited_text == "" and second.edited_text[-10:] == found_text(hard, 1)[: second.n_chars // 2][-10:]
    assert found[5][0].near_next == 1.0 and 0 <= min(r.near_edited for rows in found.values() for r in rows)
    marks = by_id(fingerprints(hard).collect())
    assert {r.fingerprint for i in (3, 4) for r in marks[i]} == {marks[8][0].fingerprint} and all(r.fingerprint == marks[r.doc_id][0].fingerprint for i in (1, 2, 6, 7) for r in found[i])


def found_text(docs, i):
    return docs.where(F.col("doc_id") == i).first().text


def test_license_scan(hard):
    found = by_id(license_scan(hard).collect())
    assert (found[9][0].n_licenses, found[9][0].licenses, found[9][0].containment) == (1, "apache-2.0", 1.0)
    assert [(r.n_licenses, r.licenses, r.containment) for i in (3, 4, 7) for r in found[i]] == [(0, "", None)] * 3
    assert len(found[5]) == 1  # equal rows are one


def test_mixed(hard):
    rows = mixed(hard).collect()
    assert all(r.text.split() for r in rows) and not {3, 4, 8} & {r.doc_id for r in rows}
    own = {r.doc_id: (r.text or "").split() for r in hard.collect() if r.doc_id is not None}
    assert all(set(r.text.split()) <= set(own[r.doc_id]) for r in rows if r.doc_id is not None)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_scores(hard):
    labels = hard.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    labels = labels.unionByName(labels.limit(3)).unionByName(labels.limit(2).withColumn("toxic", F.lit(None).cast("int")))
    rows = score(hard, fit(hard, labels)).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if not (r.text or "").strip()}) == 1
    alike = {}
    for r in rows:
        assert alike.setdefault(r.text or "", r.score) == r.score
    one = labels.where("toxic = 1")
    assert {r.score > 0.9 for r in score(hard, fit(hard, one)).collect()} == {True}  # one class alone
    assert {r.score for r in score(hard, fit(hard, labels.limit(0))).collect()} == {0.5}
