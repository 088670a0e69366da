import hashlib
import io
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.common import LONG, NEAR, ROWS, SCHEMA, docs, shingles, stored, words


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("docs") / "d")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("none") / "d", [])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_lm_scores(spark, table, empty):
    from quillstone.llm.lm_scoring import HELD, TEST, TRAIN, score_texts

    kind = F.when(F.col("doc_id") % 4 == 0, TEST).when(F.col("doc_id") % 4 == 1, HELD).otherwise(TRAIN)
    out, model = score_texts(table, kind)
    tokens = [(d, words(lower(t)) + [""]) for d, t, *_ in ROWS]
    train = [w for d, w in tokens if d is None or d % 4 != 0]
    c1 = Counter(x for w in train for x in w)
    c2 = Counter(p for w in train for p in zip(["", *w], w))
    n, v = sum(c1.values()), len(c1)
    assert (model.tokens, model.types) == (n, v) and np.allclose(model.weights.sum(axis=1), 1)
    from quillstone.llm.lm_scoring import BUCKETS

    def expected(w):
        base = sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for u, x in zip(["", *w], w):
            m = model.weights[np.searchsorted(BUCKETS, c1[u], "right") - 1]
            score += math.log10(m[0] / (v + 1) + m[1] * c1[x] / n + (m[2] * c2[u, x] / c1[u] if c1[u] else 0))
        return len(w), sum(c1[x] > 0 for x in w), round(base, 6), round(score, 6)

    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base, 6), round(r.score, 6)) for r in out.collect())
    assert got == sorted((str(d), *expected(w)) for d, w in tokens)
    none, m = score_texts(empty, F.lit(TRAIN))
    assert none.count() == 0 and m.tokens == 0
    untrained, _ = score_texts(table, F.lit(TEST))
    assert untrained.count() == len(ROWS)


def test_lm_weights_are_those_of_em_over_all_events(spark, tmp_path, monkeypatch):
    """Weights against an EM written out over every held-out token of texts from a small chain of words."""
    from quillstone.llm import lm_scoring
    from quillstone.llm.lm_scoring import BUCKETS, HELD, TRAIN, score_texts

    monkeypatch.setattr(lm_scoring, "EXACT_ROUNDS", 60)
    monkeypatch.setattr(lm_scoring, "STILL", 1e-7)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{(k * k + int(rng.integers(0, 3))) % 40}" for k in rng.integers(0, 60, 30)), "en", "a", 1) for i in range(120)]
    _, model = score_texts(stored(spark, tmp_path / "d", rows), F.when(F.col("doc_id") % 5 == 0, HELD).otherwise(TRAIN))
    texts = {d: ["", *words(t), ""] for d, t, *_ in rows}
    other = [w for d, w in texts.items() if d % 5]
    c1, c2 = Counter(x for w in other for x in w[1:]), Counter(p for w in other for p in zip(w, w[1:]))
    types, n = len({x for w in texts.values() for x in w[1:]}), sum(c1.values())
    events = [(c1[u], c1[x], c2[u, x]) for d, w in texts.items() if d % 5 == 0 for u, x in zip(w, w[1:])]
    for k in set(np.searchsorted(BUCKETS, [e[0] for e in events], "right") - 1) - {0}:
        own = [(1 / (types + 1), cw / n, both / cu) for cu, cw, both in events if np.searchsorted(BUCKETS, cu, "right") - 1 == k]
        mix = np.full(3, 1 / 3)
        for _ in range(3000):
            share = np.array(own) * mix
            mix = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        reach = lambda m: np.log10((np.array(own) * m).sum(axis=1)).mean()
        assert abs(reach(model.weights[k]) - reach(mix)) < 1e-4
    assert model.held_out[-1] >= model.held_out[0] - 1e-12


def test_lm_em_prefers_what_predicts():
    from quillstone.llm.lm_scoring import STEPS, fit_weights

    cell = 3 * STEPS * STEPS
    seen = fit_weights(np.array([[cell + 70, 100.0, 90.0, 0.1]]), 1000)
    assert seen[3, 2] > 0.99 and np.allclose(seen[4], seen[3])
    assert np.allclose(fit_weights(np.zeros((0, 4)), 10).sum(axis=1), 1)


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_sharding(table, empty, shards):
    from quillstone.llm.sharding import shard_rows

    got = shard_rows(table, shards=shards).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < shards
    assert shard_rows(empty, shards=shards).count() == 0


def test_sharding_is_even(spark, tmp_path):
    from quillstone.llm.sharding import shard_rows

    rows = [(i, "x" * (37 * i % 101), "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(3000)]
    t = stored(spark, tmp_path / "d", rows)
    sizes = [r.s for r in shard_rows(t, target_bytes=10_000).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == math.ceil(sum(len(r[1]) + 8 for r in rows) / 10_000) and max(sizes) - min(sizes) < 600


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(table, empty, weak):
    from quillstone.llm.exact_dedup import exact_groups

    # With digests of three values every block is matched by content.
    digest = {"digest": lambda b: (F.crc32(b) % 3).cast("string").cast("binary")} if weak else {}
    got = exact_groups(table, block_bytes=64, **digest).collect()
    import re

    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t, *_ in ROWS]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    least = {t: min((x for x in v if x is not None), default=None) for t, v in groups.items()}
    want = Counter((d, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_groups(empty).count() == 0


def test_urls(spark):
    from quillstone.llm import url_filter

    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "bare", ""), ("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("block", "a.co", "m/x"), ("allow", "zz.zz", "/x"), ("block", None, None), ("block", "q?", "/q")]
    urls = [
        None, "", "no scheme", "http://x.net", "http://X.NET/", "http://example.net/en/a?b", "http://badexample.net/en/", "https://m.example.com/de/", "https://m.example.com/de", "http://org/fr/x#y",
        "http://bare?x", "http://a.b/xy", "http://a.b/y", "a://b://c.net/", "http://" + "a." * 5000 + "net/" + "p" * 9000, "http://x.net/", "http://x.net/", "http://a.com/xyz", "http://q?/q", "file:///x",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))
    r = spark.createDataFrame(rules, "action string, host string, path string")

    def expected(u):
        import re

        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in ((a, h or "", p or "") for a, h, p in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *((max(fits)[3], max(fits)[4]) if fits else (None, "allow")))

    want = [(i, *expected(u)) for i, u in enumerate(urls)]
    for most in (url_filter.MAX_BROADCAST_RULES, 0):  # broadcast, then salted shuffle
        old, url_filter.MAX_BROADCAST_RULES = url_filter.MAX_BROADCAST_RULES, most
        try:
            got = url_filter.judge_urls(pages, r).orderBy("page_id").collect()
        finally:
            url_filter.MAX_BROADCAST_RULES = old
        assert [(x.page_id, x.host, x.path, x.rule, x.verdict) for x in got] == want
    none = url_filter.judge_urls(pages, r.limit(0))
    assert none.count() == len(urls) and none.filter("rule IS NOT NULL OR verdict <> 'allow'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), r).count() == 0


def test_quality(spark, tmp_path):
    from quillstone.llm.quality import classify

    good = [(i, f"A quite ordinary sentence number {i}, with words and more words of its own {i * 7}.", "en", f"s{i % 3}", 1) for i in range(60)]
    bad = [(100 + i, f"BUY!!! NOW### {i} $$$ BUY!!! NOW### BUY!!! NOW### BUY!!!", "en", "spam", 1) for i in range(30)]
    t = stored(spark, tmp_path / "d", good + bad + [(200, None, None, None, None), (200, None, None, None, None), (201, "one", "en", "new", 1)])
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 30, 2)] + [(None, 1), (5, None), (999, 0)], "doc_id long, quality int")
    out = classify(t, labels, F.col("source"), F.col("lang")).collect()
    assert {r.doc_id for r in out if r.good} >= set(range(60)) and not any(r.good for r in out if r.doc_id is not None and 100 <= r.doc_id < 130)
    assert len(out) == 93 and all(0 < r.posterior < 1 and 0 < r.path_rate < 1 for r in out)
    rate = {r.host: r.host_rate for r in out}
    assert rate["spam"] < rate[None] < rate["s1"]
    assert classify(t, labels.limit(0), F.col("source"), F.col("lang")).filter("good").count() == 93
    assert classify(t.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


PAGES = [(1, "http://a/\r\nx", "p" * 2000), (2, None, "p" * 2000), (3, "u", "q" * 999), (4, "u", "q" * 999), (5, "u", None), (6, "u", ""), (None, "u", "r" * 1500), (7, "u", "r" * 1500), (8, "u", "s" * 1200), (8, "u", "s" * 1200), (9, "é", "中" * 500_000)]


def test_warc_round_trip(spark, tmp_path):
    from quillstone.llm.warc import read_archives, write_archives

    spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).write.parquet(str(tmp_path / "p"))
    t = spark.read.parquet(str(tmp_path / "p"))
    archives = write_archives(t)
    got = read_archives(archives).collect()
    page = lambda x: None if x is None else x.split(":")[2]
    seen = sorted((page(r.record_id), r.record_type, page(r.refers_to), r.payload_bytes, r.payload_digest) for r in got)
    sha = lambda t: (len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest())
    want = [("1", "revisit", "2"), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("6", "response", None), ("null", "revisit", "7"),
            ("7", "response", None), ("8", "response", None), ("8", "revisit", "8"), ("9", "response", None)]
    text = {str(p) if p is not None else "null": h for p, _, h in PAGES}
    assert Counter(seen) == Counter((p, k, r, *sha(text[p])) for p, k, r in want)
    assert {r.url for r in got} == {"http://a/\r\nx", None, "u", "é"}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert read_archives(write_archives(t.limit(0))).count() == 0


def test_warc_checks():
    from quillstone.llm.warc import build_record, parse_record, read_records

    record = build_record("urn:x-page:1:0", "http://a", b"body", None)
    assert parse_record(record)["payload"] == b"body"
    for broken in (record[:-1], record.replace(b"WARC/1.1", b"WARC/9.9"), record.replace(b"body", b"bodY"), record.replace(b"WARC-Date", b"X-Date"), record.replace(b"Content-Length: 4", b"Content-Length: 5"), b""):
        with pytest.raises(ValueError):
            parse_record(broken)
    dictionary = b"body and more of the body " * 40
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    frames = b"".join(packer.compress(record) for _ in range(3))
    for stored_as in (dictionary, zstandard.ZstdCompressor().compress(dictionary)):
        archive = struct.pack("<II", 0x184D2A5D, len(stored_as)) + stored_as + frames
        assert list(read_records(io.BytesIO(archive))) == [record] * 3
    assert list(read_records(io.BytesIO(zstandard.ZstdCompressor().compress(record)))) == [record]
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(archive[:-3])))
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(archive[:20])))


def brute_join(rows, threshold=0.8):
    sets = [shingles(t) for _, t, *_ in rows]
    link = [[b for b in range(len(rows)) if a != b and (sets[a] == sets[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9))] for a in range(len(rows))]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, bs in enumerate(link):
            for b in bs:
                if root[b] != root[a]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root[i]].append(r[0])
    first = lambda ids: min((x for x in ids if x is not None), default=None)
    return Counter((r[0], first(least[root[i]]), len(link[i]), len({sets[b] for b in link[i]} - {sets[i]})) for i, r in enumerate(rows))


def test_jaccard_join(spark, table, empty):
    from quillstone.llm.chosen_path import jaccard_join

    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_texts) for r in jaccard_join(table).collect())
    assert got == brute_join(ROWS)
    assert jaccard_join(empty).count() == 0


def test_jaccard_join_of_crowded_paths(spark, tmp_path, monkeypatch):
    """Small limits make paths split, stick and be compared in chunks; a passage that many share links nothing."""
    from quillstone.llm import chosen_path

    monkeypatch.setattr(chosen_path, "LEAF", 8)
    rng = np.random.default_rng(1)
    passage = " ".join(f"p{i}" for i in range(60))
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        near = list(base)
        for k in rng.integers(0, 80, int(rng.integers(0, 5))):
            near[k] = f"n{i}_{k}"
        rows.append((i, " ".join(near), "en", "a", 1))
    rows += [(1000 + i, passage + " " + " ".join(f"u{i}_{k}" for k in range(150)), "en", "a", 1) for i in range(120)]
    rows += [(2000 + i, " ".join(f"c{i // 3}_{k}" for k in range(12)) + (" z" if i % 3 == 2 else ""), "en", "a", 1) for i in range(60)]
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_texts) for r in chosen_path.jaccard_join(stored(spark, tmp_path / "d", rows)).collect())
    assert got == brute_join(rows)


def test_runs_reach_the_recall():
    from quillstone.llm.chosen_path import BRANCHES, DEEPER, DEPTH, positions_for, runs_for

    for threshold in (0.2, 0.25, 0.5, 0.8, 0.95):
        met = threshold * (1 - (1 - threshold) ** DEEPER) ** (DEPTH - 1)
        runs = runs_for(0.999999, threshold)
        assert runs_for(0.9, threshold) <= runs and (1 - met) ** (BRANCHES * runs) <= 1e-6 * (1 + 1e-9)
        positions = positions_for(runs)
        assert positions >= runs * BRANCHES and positions & (positions - 1) == 0


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_jaccard_join_at_other_thresholds(spark, tmp_path, threshold):
    from quillstone.llm.chosen_path import jaccard_join

    rng = np.random.default_rng(7)
    rows = []
    for i in range(90):
        base = [f"g{i // 6}_{k}" for k in range(40)]
        a = int(rng.integers(0, 25))
        base[a : a + int(rng.integers(0, 14))] = [f"n{i}"]
        rows.append((i, " ".join(base), "en", "a", 1))
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_texts) for r in jaccard_join(stored(spark, tmp_path / "d", rows), threshold).collect())
    assert got == brute_join(rows, threshold)


def test_components(spark):
    from quillstone.llm.components import connected_components

    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}


def test_fingerprints(spark, table, empty):
    from quillstone.llm.fingerprints import add_fingerprint, likeness, to_hex

    t = add_fingerprint(table.select("doc_id", "text", "h"), "text", "fp").select("doc_id", "text", to_hex(F.col("fp")).alias("x"), "fp")
    rows = t.collect()
    by = defaultdict(set)
    for r in rows:
        by[r.text].add(r.x)
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[""] == {""} and all(len(r.x) in (0, 512) for r in rows)
    pairs = t.alias("a").join(t.alias("b"), F.lit(True)).select("a.text", F.col("b.text").alias("other"), likeness(F.col("a.fp"), F.col("b.fp")).alias("s")).collect()
    for a, b, s in pairs:
        x, y = shingles(a), shingles(b)
        assert abs(s - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.15, (a, b, s)
    assert add_fingerprint(empty, "text", "fp").count() == 0


def test_next_rows(spark, tmp_path, monkeypatch):
    """Ties and nulls, ids over the whole range, small stretches: one cycle in falling order of ids."""
    from quillstone.llm import fingerprints

    for size, many in ((fingerprints.STRETCH_ROWS, 8), (2, 60)):
        monkeypatch.setattr(fingerprints, "STRETCH_ROWS", size)
        ids = ([None, 5, 5, -9 * 10**18, 9 * 10**18, 7, 8, 9] * many)[: 8 * many]
        spark.createDataFrame([(d, f"t{i}") for i, d in enumerate(ids)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / f"d{size}"))
        t = spark.read.parquet(str(tmp_path / f"d{size}"))
        got = {r.text: (r.doc_id, r.next_text) for r in fingerprints.with_next(t, "doc_id", ["text"]).collect()}
        assert len(got) == len(ids)
        seen, at = [], max((t for t in got if got[t][0] is not None), key=lambda t: got[t][0])
        first = {got[x][1] for x in got if got[x][0] is None} & {x for x in got if got[x][0] == 9 * 10**18}
        assert len(first) == 1  # after the last null the first row follows
        at = first.pop()
        for _ in ids:
            seen.append(got[at][0])
            at = got[at][1]
        assert seen == sorted(ids, key=lambda d: (d is None, -(d or 0))) and len({x for _, x in got.values()}) == len(ids)
    none = spark.createDataFrame([(None, f"t{i}") for i in range(40)], "doc_id long, text string")
    got = {r.text: r.next_text for r in fingerprints.with_next(none, "doc_id", ["text"]).collect()}
    assert len(set(got.values())) == 40
    single = fingerprints.with_next(t.limit(1), "doc_id", ["text"]).collect()
    assert [r.next_text for r in single] == [single[0].text]
    assert fingerprints.with_next(t.limit(0), "doc_id", ["text"]).count() == 0


def library(vocabulary):
    """The tokenizer library with the pattern of the vocabulary."""
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks(), special_tokens={})


def test_bpe(spark, table, empty):
    import public_tokenizers as P

    from quillstone.llm.bpe import Vocabulary, decode_ids, digests, encode_texts

    vocabulary = Vocabulary(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    encoded = encode_texts(table, vocabulary)
    got = Counter((r.doc_id, tuple(r.tokens), bytes(r.data)) for r in decode_ids(encoded, vocabulary).collect())
    machine = library(vocabulary)
    assert got == Counter((d, tuple(machine.encode_ordinary(t or "")), (t or "").encode()) for d, t, *_ in ROWS)
    one = encode_texts(table, vocabulary, finish=digests(vocabulary)).filter("doc_id = 7").first()
    assert one.n_tokens == len(machine.encode_ordinary(LONG)) and one.decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert encode_texts(empty, vocabulary).count() == 0
    odd = spark.createDataFrame([(1, [0, -1, 60_000]), (2, None)], "doc_id int, tokens array<int>")
    assert [bytes(r.data) for r in decode_ids(odd, vocabulary).orderBy("doc_id").collect()] == [machine.decode_bytes([0]), b""]


def test_pre_tokens_agree_with_the_library(spark):
    import public_tokenizers as P
    import regex

    from quillstone.llm.bpe import Vocabulary

    vocabulary = Vocabulary(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    machine, one = library(vocabulary), vocabulary.encoder().encode_ordinary
    find, rng = regex.compile(P.PATTERN).findall, np.random.default_rng(2)
    pool = [chr(c) for c in [*range(0, 0x250), *range(0x2000, 0x2070), *range(0x3000, 0x3050), 0x1F600, 0x10400, 0xFE0F, 0x301]]
    for _ in range(300):
        t = "".join(rng.choice(pool, 60))
        assert [i for w in find(t) for i in one(w)] == machine.encode_ordinary(t)


def test_mixing(spark, tmp_path, table, empty):
    from quillstone.llm.mixing import mix_sources

    out = mix_sources(table).collect()
    sizes = defaultdict(int)
    for d, t, _, s, _ in ROWS:
        sizes[s] += len(words(t))
    assert {r.source: r.source_size for r in out} == dict(sizes) and len(out) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    target = {r.source: r.target for r in out}
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(t <= 2 * sizes[s] + 1e-9 for s, t in target.items())
    assert mix_sources(empty).count() == 0

    rows = [(i, "w " * (1 + i % 9), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(3000)]
    t = stored(spark, tmp_path / "d", rows)
    out = mix_sources(t)
    per = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 9 for r in per)
    assert sorted(out.collect()) == sorted(mix_sources(t.repartition(7)).collect())

    # Ids may be structs; rows without ids, and rows alike in all, may be most of the table.
    keyed = t.withColumn("doc_id", F.struct(F.lit(1).alias("a"), F.struct(F.col("doc_id").alias("b")).alias("c")))
    assert abs(sum(r.taken for r in mix_sources(keyed).collect()) - 1.5 * sum(len(words(r[1])) for r in rows)) <= 9
    alike = [(None, "w w", "en", "x", 1)] * 2500 + [(7, "w", "en", "y", 1)] * 40 + [(i, "w " * i, "en", "z", 1) for i in range(20)]
    got = mix_sources(stored(spark, tmp_path / "alike", alike)).collect()
    assert len(got) == 2560 and Counter(r.doc_id for r in got)[None] == 2500 and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)


def test_schema_of_fixture(spark):
    assert docs(spark, extra=False).schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString() and NEAR
