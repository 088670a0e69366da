import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.llm.oracles import ORACLES
from quillstone.llm.queries import QUERIES
from tests.llm.common import ROWS, stored, words
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], SF)


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_a_row_a_document(spark, name):
    ids = Counter(duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet'").df().doc_id)
    assert Counter(QUERIES[name](spark, SF).toPandas().doc_id) == ids


def test_pipeline(spark, tmp_path):
    """Each stage keeps its columns; what stays is what brute force keeps."""
    import corpus_pipeline
    from tests.llm.test_operators import brute_join

    stored(spark, tmp_path / "documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(1, 14)] + [(14, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["quality_classifier"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.filter("doc_id = 14").count() == 0 and kept.count() == len(ROWS) - 1
    assert [r.name for r in kept.select("name").distinct().collect()] == ["clash"]

    exact = steps["exact_dedup"](spark, docs, str(tmp_path))
    norm = {}
    for d, t, *_ in ROWS:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    assert exact.columns == docs.columns
    assert Counter(r.doc_id for r in exact.collect()) == Counter(min(v, key=lambda x: (x is None, x or 0)) for v in norm.values())

    near = steps["near_dedup"](spark, docs, str(tmp_path))
    assert near.columns == docs.columns and Counter(r.doc_id for r in near.collect()) == Counter({c for _, c, *_ in brute_join(ROWS)})

    mixed = steps["fair_mixing"](spark, docs, str(tmp_path))
    total, got = sum(len(words(r[1])) for r in ROWS), sum(len(words(r.text)) for r in mixed.collect())
    assert mixed.columns == docs.columns and 0.3 * total < got <= 1.5 * total

    last = steps["byte_bpe"](spark, docs, str(tmp_path))
    assert last.count() == len(ROWS) and last.filter(F.size("tokens") != F.col("n_tokens")).count() == 0

    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def _documents():
    return duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").df()


def test_op1_against_brute_force(spark):
    """The split, the counts and the base score of every document; the score is a log10 probability of a text that gains over the base."""
    import math
    import zlib

    docs = _documents()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = {int(d): words(lower(t)) + [""] for d, t in zip(docs.doc_id, docs.text, strict=True)}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(x for d, w in tokens.items() if not held[d] for x in w)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in QUERIES["op1_deleted_interpolation"](spark, SF).collect()}
    for d, w in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(x in c for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w)) < 1e-6 * max(1, len(w))
        assert r.score <= 0
    gain = sum(r.score - r.base_score for r in got.values() if r.held_out)
    assert gain > 0


def test_op8_against_brute_force(spark):
    """Edited texts, their digests and lengths, and likenesses near the true similarity of shingles."""
    import hashlib

    from tests.llm.common import shingles

    docs = _documents().sort_values("doc_id", ascending=False)
    ids, texts = [int(d) for d in docs.doc_id], [t or "" for t in docs.text]
    got = {r.doc_id: r for r in QUERIES["op8_minhash"](spark, SF).collect()}
    like = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) if shingles(a) | shingles(b) else 1.0
    errors = []
    for k, (d, t) in enumerate(zip(ids, texts, strict=True)):
        other = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        errors += [abs(r.near_edited - like(t, edited)), abs(r.near_next - like(t, other))]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    by_text = {}
    for d, t in zip(ids, texts, strict=True):
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def test_op5_on_held_out_labels(spark):
    """Fitted without a fifth of the labels, the verdicts agree with them; posteriors follow from the documents' own probabilities."""
    import math
    from collections import defaultdict

    from quillstone.llm import quality

    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    out = {r.doc_id: r for r in quality.classify(docs, labels.filter("doc_id % 5 <> 0"), F.col("source"), F.col("lang"), keep=["doc_id"]).collect()}
    held = [(r.quality, out[r.doc_id]) for r in labels.filter("doc_id % 5 = 0").collect() if r.doc_id in out]
    assert len(held) > 40 and sum(r.good == (q == 1) for q, r in held) / len(held) >= 0.97
    good, bad = ([r.posterior for q, r in held if q == k] for k in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) >= 0.99

    # The grouped rates, by plain sums.
    by_host, by_path = defaultdict(list), defaultdict(list)
    for r in out.values():
        by_host[r.host].append(r.p_doc)
        by_path[r.host, r.path].append(r.p_doc)
    n = len(out)
    rate = (sum(r.p_doc for r in out.values()) + 0.5) / (n + 1)

    def weight(groups):
        chance = rate * (1 - rate)
        spread = sum(len(g) * (sum(g) / len(g) - towards) ** 2 for g, towards in groups)
        free = n - sum(len(g) ** 2 for g, _ in groups) / n
        between = (spread - (len(groups) - 1) * chance) / free
        return min(quality.MOST_PRIOR, max(quality.LEAST_PRIOR, chance / between - 1)) if between > 0 else quality.MOST_PRIOR

    host_weight = weight([(g, rate) for g in by_host.values()])
    path_weight = weight([(g, sum(by_host[h]) / len(by_host[h])) for (h, _), g in by_path.items()])
    logit = lambda p: math.log(p / (1 - p))
    base = None
    for r in out.values():
        h, g = by_host[r.host], by_path[r.host, r.path]
        host = (host_weight * rate + sum(h) - r.p_doc) / (len(h) - 1 + host_weight)
        path = (path_weight * host + sum(g) - r.p_doc) / (len(g) - 1 + path_weight)
        assert abs(r.host_rate - host) < 1e-9 and abs(r.path_rate - path) < 1e-9 and r.good == (r.posterior >= 0.5)
        # Evidence is what the posterior adds to the site's rate, and p_doc to the base rate: one base for all.
        if 1e-6 < r.p_doc < 1 - 1e-6 and 1e-9 < r.posterior < 1 - 1e-9:
            here = logit(r.p_doc) - (logit(r.posterior) - logit(r.path_rate))
            base = here if base is None else base
            assert abs(here - base) < 1e-5


def test_rows_stay_apart_when_files_are_split_anew(spark, tmp_path, monkeypatch):
    """Between any two scans of an operator the number of splits changes, as when executors come and go."""
    import corpus_pipeline
    from quillstone.llm import chosen_path, exact_dedup, mixing, warc, workspace
    from tests.llm.common import SCHEMA

    rows = [(i if i % 9 else None, f"text {i % 150} " * (1 + i % 4), "en", f"s{i % 3}", 1) for i in range(600)]
    spark.createDataFrame(rows, SCHEMA).repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.repeat("text", 90).alias("html"))

    def results():
        exact = exact_dedup.exact_groups(docs).collect()
        steps = {k: sorted(map(str, f(spark, docs, str(tmp_path)).collect())) for k, f in corpus_pipeline.STAGES if k in ("exact_dedup", "near_dedup", "fair_mixing")}
        join = chosen_path.jaccard_join(docs).collect()
        read = warc.read_archives(warc.write_archives(pages), payloads=False).collect()
        kinds = Counter((r.record_type, r.payload_digest) for r in read)
        return Counter(map(str, exact)), steps, Counter(map(str, join)), kinds

    want = results()
    splits, plain = [4, 12, 2, 7], workspace.write_table

    def write_table(df, tag, lasting=False, rows=None):
        out = plain(df, tag, lasting, rows)
        splits.append(splits.pop(0))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(splits[0]))
        return out

    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        for module in (workspace, chosen_path, exact_dedup):
            monkeypatch.setattr(module, "write_table", write_table)
        assert {m.write_table for m in (workspace, chosen_path, exact_dedup)} == {write_table} and mixing.materialize is workspace.materialize
        assert results() == want
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")
