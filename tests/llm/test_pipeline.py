"""The pipeline's stages on small tables with odd rows."""

import random

import pytest

import corpus_pipeline
from wavecrest.llm import common, jaccard, site_quality, toxicity
from wavecrest.llm import quality_rules as rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, _site_host int, component_id long"
SMALL = "/root/testdata/sf0.001"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", 1, 2) for i, t in rows], SCHEMA)


def prose(rnd, n=80):
    return " ".join(rnd.choice(["the", "of", "tree", "river", "stone", "light", "seven"]) + str(rnd.randrange(90)) for _ in range(n)) + "."


def test_near_duplicates_keep_unlike_rows(spark):
    rnd = random.Random(5)
    a, b, c, d = (prose(rnd) for _ in range(4))
    rows = [(5, a), (5, b), (None, c), (None, d), (7, a + " more"), (8, None), (9, ""), (None, c), (5, a)]
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, rows_of(spark, rows), SMALL).collect()]
    texts = [t for _, t in out]
    assert texts.count(b) == texts.count(c) == texts.count(d) == 1 and len(set(texts)) == len(texts)
    assert sum(t in (a, a + " more") for t in texts) == 1
    assert None in texts and "" in texts
    unique = [(3, a), (2, a + " x"), (1, b)]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows_of(spark, unique), SMALL).collect()) == [1, 2]


def test_quality_judges_rows_by_themselves(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in site_quality.classify(docs, labels).where("kept").collect()}
    out = corpus_pipeline.quality(spark, docs, SMALL)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    assert 0 < len(kept) < docs.count()


def test_stages_on_empty_and_odd_tables(spark):
    rnd = random.Random(6)
    odd = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, prose(rnd)), (4, prose(rnd, 30000)), (5, "call a.b@c.org")]
    for rows in ([], odd):
        docs = rows_of(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name == corpus_pipeline.STAGES[-1][0]:
                assert out.count() >= (1 if rows else 0)
            else:
                assert out.schema.fieldNames() == docs.schema.fieldNames(), name
                docs = common.materialize(out)
        assert docs.count() <= len(rows)


def test_whole_run(spark):
    """Each stage's decisions take effect: what the operators reject isn't packed."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.judge(docs, labels).where("rejected").collect()}
    packed = corpus_pipeline.run(spark, SMALL)
    ids = {r.doc_id for r in packed.collect()}
    clean = common.materialize(docs.where(~docs.doc_id.isin(toxic)))
    good = common.materialize(site_quality.keep_good(clean, labels))
    firsts = {r.doc_id for r in jaccard.near_classes(good).where("doc_id = component_id").collect()}
    assert toxic and not ids & toxic and ids == firsts


def test_many_sites_are_joined(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    want = sorted((r.doc_id, round(r.posterior, 9)) for r in site_quality.classify(docs, labels).collect())
    monkeypatch.setattr(site_quality, "BROADCAST_SITES", 0)
    assert sorted((r.doc_id, round(r.posterior, 9)) for r in site_quality.classify(docs, labels).collect()) == want


def test_site_posteriors_by_hand(spark):
    """Counts, shrinkage and posteriors against plain sums."""
    import math
    from collections import defaultdict

    rnd = random.Random(7)
    rows = [(k, rnd.choice("abc"), rnd.choice("xy"), rnd.random()) for k in range(200)]
    evidence = spark.createDataFrame([(k, h, f"{h}/{p}", v) for k, h, p, v in rows], "doc_id long, host string, path string, p_doc double")
    host, path = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for _, h, p, v in rows:
        for d, key in ((host, h), (path, f"{h}/{p}")):
            d[key][0] += 1
            d[key][1] += v
    mean = sum(s for _, s in host.values()) / 200
    shares = [s / n for n, s in host.values()]
    var = sum((x - sum(shares) / 3) ** 2 for x in shares) / 3 - sum(1 / n for n, _ in host.values()) / 3 * mean * (1 - mean)
    kappa = min(max(mean * (1 - mean) / max(var, 1e-9) - 1, site_quality.LEAST), site_quality.MOST)
    for r in site_quality.site_priors(evidence).collect():
        n, s = host[r.host]
        prior = (s + kappa * mean) / (n + kappa)
        n, s = path[r.path]
        assert math.isclose(r.prior_host, prior, rel_tol=1e-9) and math.isclose(r.prior_path, (s + kappa * prior) / (n + kappa), rel_tol=1e-9)


def test_operators_on_empty_tables(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    empty = rows_of(spark, [])
    assert rules.apply_rules(empty, labels).count() == 0
    assert toxicity.judge(empty, labels).count() == 0
    assert site_quality.classify(empty, labels).count() == 0
    assert rules.apply_rules(rows_of(spark, [(1, "a b")]), labels.limit(0)).count() == 1


def test_shared_folder_is_asked_for():
    class Context:
        master = "spark://somewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        common.shared_dir(Session)
