import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from civisphere.llm import byte_bpe, mixing, toxicity

from .test_operators import brute_lines, union


def near(rows):
    """Components of texts alike by 0.8 in five-word shingles, by brute force."""
    own = {r: (r[1] or "").lower().split() for r in rows}
    sets = {r: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r, w in own.items()}
    names = list(sets)
    links = [(i, j) for i, a in enumerate(names) for j, b in enumerate(names[:i]) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = union(links, range(len(names)))
    return {r: root[i] for i, r in enumerate(names)}


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).ranks.ranks, special_tokens={})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d).cache()
        before = [(r.doc_id, r.text) for r in docs.collect()]
        ids = {r.doc_id for r in out.collect()}
        if k == 0:
            model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
            assert ids == {i for i, t in before if model.score(t)[0] < toxicity.THRESHOLD}
        elif k == 1:
            assert {(r.doc_id, r.text) for r in out.collect()} == {(r[0], t) for r, t in brute_lines(before).items() if t.strip(" \t\r\n")}
        elif k == 2:
            root = near(before)
            assert ids == {min(i for (i, t), c in root.items() if c == x) for x in set(root.values())} and out.count() == len(ids)
        elif k == 3:
            assert ids == {r.doc_id for r in mixing.mix(docs).where("sampled").collect()}
        else:
            want = sorted(byte_bpe.digest_ids(ref.encode_ordinary(t or "")) for _, t in before)
            assert sorted(r.ids_sha256 for r in out.collect()) == want
        assert k == 4 or out.columns == docs.columns
        docs = out
    assert docs.count() > 0


def test_odd_rows(spark, odd, none):
    """Nulls, repeated rows, empty tables and clashing columns pass all stages but the first."""
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, none.withColumn("drop", F.lit(1)), "").count() == 0
        assert stage(spark, odd.withColumns({c: F.lit(1) for c in ("s", "l", "ratio", "drop", "doc", "row", "c")}), "").count() > 0


def test_one_of_each_group(spark):
    """Documents that share an id, or have none, are told apart by their text."""
    rows = [(7, "one text of its own here"), (7, "another quite different text"), (None, "the third of them all"), (None, "the fourth of them all"), (None, "the fourth of them all"), (8, "one text of its own here"), (9, "x y"), (9, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(map(str, out)) == sorted(map(str, [docs.collect()[k] for k in (0, 1, 2, 3, 6)]))


def test_mixing_meets_targets(spark):
    """Rows of the stage have the target shares of tokens, cells below their share too."""
    rows = [(i, "word " * 40, "en" if i % 25 else "es", "big" if i % 20 else "small", 200) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.sample_mix(spark, docs, "").collect()
    assert set(out) <= set(docs.collect())
    for column, k in (("source", 3), ("lang", 2)):
        own = {v: sum(r[k] == v for r in rows) ** mixing.FLATTEN[column] for v in {r[k] for r in rows}}
        for v, x in own.items():
            goal = 6000 * x / sum(own.values())
            assert abs(sum(r[column] == v for r in out) / goal - 1) < 0.08


def test_near_copies_go(spark):
    """Copies with scattered edits, which fingerprints at distance two miss, by brute force."""
    rows = []
    for i in range(60):
        words = [f"w{i // 12}x{k}" for k in range(200)]
        for k in range(i % 12 % 7):
            words[(i * 31 + k * 29) % 200] = f"edit{i}y{k}"
        rows.append((i, " ".join(words).upper() if i % 12 == 5 else " ".join(words)))
    rows += [(60, "one two"), (61, "One  two"), (62, "one three"), (63, ""), (64, None), (65, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in own.items()}
    root = union([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], sets)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in out) == sorted(set(root.values()))
    assert len(out) < docs.count() / 3
