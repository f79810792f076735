import hashlib
import re
import time
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civisphere.llm import byte_bpe, language_id, line_dedup, merkle, mixing, queries, sharding, simhash, token_counts, toxicity, transport_stream
from civisphere.llm.common import Scratch, connected_components

BPE = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


def union(pairs, nodes):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        at[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 100), (7, 7), (60, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 60: 50, 100: 50}
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark, "t")).count() == 0


# 1


def test_transport_stream(spark, odd, none):
    out = transport_stream.demux_streams(transport_stream.mux_texts(odd)).collect()
    assert len(out) == odd.count()
    want = sorted(transport_stream.padded(r.text) for r in odd.collect())
    assert sorted((r.n_bytes, bytes(r.ts.streams[0].data)) for r in out) == want
    assert all(r.ts.streams[0].continuity_errors == 0 and r.ts.programs == 1 and r.ts.streams[0].stamps[0].random_access for r in out)
    assert transport_stream.mux_texts(none).count() == 0


def test_transport_stream_faults():
    payload = bytes(range(256)) * 200
    media = transport_stream.mux(payload)
    p = transport_stream.PACKET
    lost = transport_stream.demux(media[: 20 * p] + media[21 * p :])
    assert lost.streams[0].continuity_errors == 1
    assert transport_stream.demux(media[: 21 * p] + media[20 * p :]).streams[0].repeated == 1
    assert transport_stream.demux(b"zz" + media).lost_bytes == 2
    broken = bytearray(media)
    broken[15] ^= 1
    assert transport_stream.demux(bytes(broken)).table_errors >= 1
    assert transport_stream.demux(b"").streams == []
    stamps = transport_stream.demux(media).streams[0].stamps
    assert [s.pts for s in stamps] == [90_000 + 3003 * k for k in range(len(stamps))]
    assert [s.random_access for s in stamps] == [k % 4 == 0 for k in range(len(stamps))]


# 2


def test_toxicity(spark, odd, none):
    bad, good = "You are a stupid loser. ", "The plan is on the table. "
    texts = [good * (k % 5 + 1) + (bad if k % 3 == 0 else "") + good for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(120)] + [(None, 1, 0), (5, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 3 == 0) for r in got)
    worst = next(r for r in got if r.doc_id == 3).offending[0]
    assert "stupid loser" in texts[3][worst.start : worst.end]
    out = toxicity.score_documents(odd, model, keep=True)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert all(r.score == 0 for r in out.where("trim(coalesce(text, '')) = ''").collect())
    empty = toxicity.fit(none, labels.limit(0))
    assert toxicity.score_documents(none, empty).count() == 0


# 3


@pytest.mark.parametrize("hot", [False, True])
def test_sharding(spark, docs, odd, hot):
    df = odd.select("doc_id", "text")
    if hot:  # a third of all rows have one text
        df = docs.select("doc_id", "text").union(spark.range(1000, 1100).select("id", F.lit("same")))
    out = sharding.shard_documents(df, 8).collect()
    sizes = defaultdict(list)
    for r in out:
        sizes[r.shard].append(r.slot)
    assert len(out) == df.count() and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    text = {r.doc_id: r.text or "" for r in df.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in out)
    if hot:
        assert len({r.shard for r in out if text[r.doc_id] == "same"}) <= 4


def test_sharding_cut(spark):
    """Groups of equal texts stay together: far fewer pairs are cut than by chance."""
    rows = [(k, f"text {k % 400}" if k < 4000 else f"own {k}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_documents(df, 24).join(df, "doc_id")
    assert sharding.cut_edges(out, "text").first()["edges"] == 400 * 45
    assert sharding.cut_edges(out, "text").first()["cut"] <= 0.02 * 400 * 45


def test_sharding_empty(none):
    assert sharding.shard_documents(none).count() == 0


# 4


def brute_lines(rows, norm=lambda x: x.strip(" \t\r").lower()):
    """Texts by (id, text), from independent shingles: five characters from every position."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    own = [(r, k, norm(x)) for r in rows if r[1] is not None for k, x in enumerate(r[1].split("\n")) if norm(x)]
    sets = {x: {x[j : j + 5] for j in range(max(1, len(x) - 4))} for _, _, x in own}
    names = sorted(sets)
    root = union([(a, b) for j, a in enumerate(names) for b in names[:j] if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))], names)
    first = {}
    for r, k, x in own:
        first.setdefault(root[x], (r, k))
    return {r: r[1] if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if not norm(x) or first[root[norm(x)]] == (r, k)) for r in rows}


def brute_chars(rows, norm):
    return {r[0]: t for r, t in brute_lines(rows, norm).items()}


def test_line_dedup(spark, docs, odd, none):
    some = docs.where("doc_id < 60").select("doc_id", "text")
    for df in (some, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = brute_lines(rows)
        out = line_dedup.dedupe_lines(df).collect()
        assert sorted((r.doc_id, r.text) for r in out if r.doc_id is not None) == sorted((r[0], want[r]) for r in rows if r[0] is not None)
    kept = line_dedup.dedupe_lines(odd, keep=True)
    assert kept.columns[: len(odd.columns)] == odd.columns and kept.count() == odd.count()
    assert line_dedup.dedupe_lines(none).count() == 0


def test_line_dedup_shared_ids(spark):
    """Rows that share an id, or have none, are documents of their own; any column name may come."""
    rows = [(None, "A line\nB line", 1, 2, 3, 4), (None, "C line\nA line", 1, 2, 3, 4), (5, "D line\nE line", 1, 2, 3, 4), (5, "F line\nD line", 1, 2, 3, 4), (6, "G line\nG line", 1, 2, 3, 4), (6, "G line\nG line", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s int, drop int, doc int, ratio int")
    out = line_dedup.dedupe_lines(docs, keep=True)
    assert out.columns == [*docs.columns, "n_lines", "n_kept"]
    got = sorted(x for r in out.collect() for x in r.text.split("\n"))
    assert got == ["A line", "B line", "C line", "D line", "E line", "F line", "G line", "G line"]
    texts = [r.text for r in out.collect() if r.doc_id == 6]
    assert texts == ["G line", "G line"]  # rows equal in id and text are one document


def test_line_dedup_family(spark):
    """A crowd of variants that are similar by steps, and some that are not."""
    words = [f"word{k}" for k in range(40)]
    rows = [(k, " ".join([*words[: k % 40], f"new{k}", *words[k % 40 + 1 :]])) for k in range(150)]
    rows += [(200 + k, " ".join([*words[: k % 30], *(f"own{k}x{j}" for j in range(k % 12)), *words[k % 30 + k % 12 :]])) for k in range(60)]
    out = line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r[0], t) for r, t in brute_lines(rows).items()}


def test_line_dedup_every_position(spark):
    """One changed character, at any place, in lines without spaces too."""
    base = ["The council met on Monday and voted for the new road plan at last.", "".join(chr(97 + 7 * k * k % 26) for k in range(90)), "日本語の文章には空白がないのでどの文字も同じように数えられなければならないのである。" * 2, "abc", "abcd"]
    rows = [(9 * j + k, x if not k else x[: 7 * k] + "#" + x[7 * k + 1 :]) for j, x in enumerate(base) for k in range(9) if 7 * k < len(x)]
    out = line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_chars(rows, str.strip)
    assert {r.doc_id: r.text for r in out} == want and sum(t != "" for t in want.values()) == 5


def test_line_dedup_case(spark):
    rows = [(1, "The Council Met On Monday"), (2, "THE COUNCIL MET ON MONDAY\nÉTÉ à Paris"), (3, "the council met on monday!\nété À PARIS\nAB")]
    out = line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == {1: rows[0][1], 2: "ÉTÉ à Paris", 3: "AB"} == brute_chars(rows, lambda x: x.strip(" \t\r").lower())


def test_line_dedup_recall(spark):
    """Of pairs of similarity 0.8 with ten shingles in all, all bands miss about 0.6 %."""
    text = lambda k: "".join(chr(97 + b % 26) for b in hashlib.sha256(str(k).encode()).digest()[:14])
    n = 6000
    docs = spark.createDataFrame([(2 * k + j, text(k)[: 12 + 2 * j]) for k in range(n) for j in (0, 1)], "doc_id long, text string")
    found = {r.k1: set(r.bands) for r in line_dedup.signatures(docs).collect()}
    keys = {r.doc: r.k1 for r in line_dedup._lines(docs).collect()}
    assert sum(not found[keys[2 * k]] & found[keys[2 * k + 1]] for k in range(n)) < 0.01 * n


def test_line_dedup_disk(spark, monkeypatch):
    """Lines to be verified are stored as texts, and what is read no more is gone by then."""
    word = lambda k, j: hashlib.sha256(f"{k} {j}".encode()).hexdigest()[:9]
    rows = [(3 * k + i, " ".join(word(k, j) for j in range(300)) + f" {i}") for k in range(40) for i in range(3)]
    size = lambda path: sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*.parquet"))
    saved, left = [], {}

    def save(self, df, name="t", own=Scratch.save):
        out = own(self, df, name)
        saved.append((name, out._scratch_path))
        if name == "sets":
            left.update((x, left.get(x, 0) + size(path)) for x, path in saved)
        return out

    monkeypatch.setattr(Scratch, "save", save)
    out = line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.text} == {3 * k for k in range(40)}
    assert 0 < left["sets"] < sum(len(t) for _, t in rows) and left["signatures"] == left["candidates"] == 0


def test_line_dedup_broadcasts(spark, monkeypatch):
    """Only sieves of bounded length are broadcast by name; with one word for all keys the result is the same."""
    word = lambda k, j: hashlib.sha256(f"{k} {j}".encode()).hexdigest()[:6]
    rows = [(3 * k + i, "\n".join([" \t".join(word(k, j) for j in range(20)) + f" {i}\r", f"only {word(k, i)} here {i}  ", "the same everywhere"])) for k in range(30) for i in range(3)]
    sent, own = [], line_dedup.F.broadcast
    monkeypatch.setattr(line_dedup.F, "broadcast", lambda df: sent.append((df.columns, df.count())) or own(df))
    monkeypatch.setattr(line_dedup, "SIEVE", 1, raising=False)
    out = line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == brute_chars(rows, lambda x: x.strip(" \t\r").lower())
    assert sent and all(c == ["word", "bits"] and n <= 1 for c, n in sent)


def test_sieved(spark):
    rows = spark.range(40_000).withColumn("k", F.col("id") * 7)
    wanted = rows.where("id % 40 = 3").select("id", "k")
    kept = {r.id for r in line_dedup.sieved(rows, wanted, "id", "k").collect()}
    assert {k for k in range(40_000) if k % 40 == 3} <= kept and len(kept) < 1000 + 39_000 / 4
    assert line_dedup.sieved(rows, wanted.limit(0), "id").count() == 0


# 5


def test_language_id(spark, odd, none):
    base = {"en": "the road is closed and the work goes on with them", "fr": "la route est fermee et le travail continue avec eux"}
    rows = [(k, " ".join(sorted(base[x].split(), key=lambda w: zlib.crc32(f"{w}{k}".encode()))), x) for k in range(60) for x in base]
    df = spark.createDataFrame([(2 * k + j, t, x) for j, (k, t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = language_id.identify(df.drop("lang"), model).join(df.select("doc_id", "lang"), "doc_id")
    assert got.where("lang <> lang_pred").count() == 0
    assert model.predict("roads closing")[0] == "en" and model.predict("fermees routes")[0] == "fr"  # unseen words
    out = language_id.identify(odd, model).collect()
    assert len(out) == odd.count() and {r.lang_pred for r in out if r.doc_id in (3, 4, 5)} == {"und"}
    assert language_id.identify(odd, language_id.fit(none)).where("lang_pred <> 'und'").count() == 0


# 6


def test_byte_bpe(spark, odd, none, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", 7)
    own = byte_bpe.encoder(BPE, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks.ranks, special_tokens={})
    texts = [r.text or "" for r in odd.collect()] + ["'ll 'l", "a  \t b", "\n\n x", "ab" * 4000, " " * 500 + "x", "don't 12 ３4!?\r\n"]
    for t in texts:
        ids = own.encode(t)
        assert ids == ref.encode_ordinary(t) and own.decode(ids) == t.encode()
    out = queries.bpe_digests(odd).collect()
    want = sorted((len(i := ref.encode_ordinary(r.text or "")), byte_bpe.digest_ids(i), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert queries.bpe_digests(none).count() == 0


@pytest.mark.parametrize("unit", ["-", ".", " ", "a", "語", "ab-", "=_"])
def test_byte_bpe_long_runs(unit):
    """Runs of a hundred thousand characters in seconds, equal to tiktoken where that is quick."""
    own = byte_bpe.encoder(BPE, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks.ranks, special_tokens={})
    for n in (1000, 1023, 20_000):
        assert own.encode(unit * n) == ref.encode_ordinary(unit * n)
    start = time.monotonic()
    assert own.decode(own.encode(unit * 100_000)) == (unit * 100_000).encode()
    assert time.monotonic() - start < 20


# 7


def brute_fingerprint(text):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", w)
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def check_simhash(df, out):
    fp = {(r.doc_id, r.text): brute_fingerprint(r.text) for r in df.collect()}
    root = union([(a, b) for a in set(fp.values()) for b in set(fp.values()) if a < b and (a ^ b).bit_count() <= 2], set(fp.values()))
    low = {}
    for (i, _), x in fp.items():
        low[root[x]] = min((j for j in (low.get(root[x]), i) if j is not None), default=None)
    want = sorted((str(i), f"{x:016x}", str(low[root[x]])) for i, x in ((r.doc_id, brute_fingerprint(r.text)) for r in df.collect()))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out.collect()) == want


def test_simhash_bridge(spark, monkeypatch):
    """Rows without an id link others; ids can be text."""
    near = {"a": 0, "b": 3, "c": 15}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", F.when(F.col("text") == "a", 0).when(F.col("text") == "b", 3).otherwise(15).cast("long").alias("fp")))
    out = simhash.near_duplicates(spark.createDataFrame([("x", "a"), (None, "b"), ("y", "c")], "doc_id string, text string")).collect()
    assert len(near) == 3 and {r.component_id for r in out} == {"x"}


def test_simhash(docs, odd, none, monkeypatch):
    check_simhash(docs, simhash.near_duplicates(docs))
    check_simhash(odd, simhash.near_duplicates(odd))
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("crowd", [1, 48])
def test_simhash_links(spark, crowd, monkeypatch):
    """All pairs at distance two or less, by pairs and by shared neighbours."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    fps = [0, 1, 3, 7 << 10, (1 << 63) | 1, 1 << 62, 0b11100000] + [(i * 0x9E3779B97F4A7C15) % (1 << 64) for i in range(3, 60)] + [1 << i for i in range(5, 40)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(fps)], "id long, fp long")
    got = {r.node: r.component for r in connected_components(simhash.near_edges(df, Scratch(spark, "t")), Scratch(spark, "t")).collect()}
    root = union([(i, j) for i, a in enumerate(fps) for j in range(i) if (a ^ fps[j]).bit_count() <= 2], range(len(fps)))
    assert {i: got.get(i, i) for i in root} == root


def test_thresholds():
    cost = [[0.0, 5.0, 50.0, 500.0], [0.0, 1.0, 2.0, 900.0]]
    assert simhash.allocate(cost, 1) == [0, 1]


# 8 and 9


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, db, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = db.sql(queries.ORACLE_SQL[name])
    assert df.columns == want.columns
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_merkle(spark, odd, none):
    out = merkle.compare_edited(odd).collect()
    assert len(out) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert len({r.fingerprint for r in out if r.doc_id in (0, 1)}) == 1
    assert merkle.compare_edited(none).count() == 0
    one = merkle.compare_edited(odd.where("doc_id = 8")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"x" * 64).hexdigest()
    pair = spark.createDataFrame([("a\nb\n\nc", "a\nB\n\nc\nd"), ("a", "a")], "a string, b string")
    pair = merkle.fingerprint_documents(merkle.fingerprint_documents(pair, "a", "fa"), "b", "fb")
    got = [[tuple(e) for e in r.edits] for r in merkle.locate_edits(pair, "fa", "fb").collect()]
    assert got == [[(0, 1, 0), (1, 1, 0)], []]


def test_merkle_full_root(spark):
    """The root is made from full leaf digests, the listed leaves are short."""
    text = "a" * 70 + "\nb\n\nc"
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    want = md5(md5(md5(",".join((md5("a" * 64), md5("a" * 6)))) + md5(md5("b"))) + md5(md5(md5("c"))))
    got = merkle.fingerprint_documents(spark.createDataFrame([(text,)], "text string")).first().fingerprint
    assert got == f"{want}:{md5('a' * 64)[:8]},{md5('a' * 6)[:8]};{md5('b')[:8]}/{md5('c')[:8]}"


def test_merkle_stretches(docs, monkeypatch):
    want = sorted(merkle.compare_edited(docs).collect())
    monkeypatch.setattr(merkle, "STRETCH", 13)
    assert sorted(merkle.compare_edited(docs).collect()) == want


def test_mixing(docs, odd, none):
    out = mixing.mix(docs).toPandas()
    ratio = out.probability * out.weight
    both = out.assign(w=ratio * out.tokens).merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    share = both.groupby("source").tokens.sum() ** mixing.FLATTEN["source"]
    assert abs(both.groupby("source").w.sum() / both.w.sum() - share / share.sum()).max() < 0.01
    assert mixing.mix(odd, keep=True).count() == odd.count() and mixing.mix(none).count() == 0


# 10


def test_token_counts(spark, odd, none):
    ref, own = Tokenizer.from_file(JSON), token_counts.counter(JSON)
    count = lambda t: len(ref.encode(t, add_special_tokens=False).ids)
    out = token_counts.count_documents(odd, JSON)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == sorted((len((r.text or "").encode()), n := count(r.text or ""), n > 1024) for r in odd.collect())
    assert token_counts.count_documents(none, JSON).count() == 0
    for t in ("it's  \t\t here\n\n x", "'ll 'l 日本 don't", "  a", "abc" * 30):
        index = token_counts.Prefixes.unpack(own.index(t).pack())
        assert [own.prefix(index, t, n) for n in range(len(t) + 1)] == [count(t[:n]) for n in range(len(t) + 1)]
    cut = token_counts.truncate_documents(odd.where("doc_id = 6"), out, JSON, 50).first().text
    assert count(cut) == 50


def test_token_counts_inside_matches(spark):
    """The stored counts hold at every character, and truncation ends inside a match."""
    ref, own = Tokenizer.from_file(JSON), token_counts.counter(JSON)
    count = lambda t: len(ref.encode(t, add_special_tokens=False).ids)
    texts = ["a \t b\n\n  c\t\td \n", "  'll 're''s  'v", "x !!<|endoftext|>'s  <|endoftext|>\n <|endoftext|><|endo", "日本語の文章🙂é " * 3, "https://example.org/aGVsbG8gd29ybGQ=" * 3, "\u00a0\u3000 a \u2003b", " " * 70 + "x" * 70, "", "\n \n'd\n\n'd"]
    for t in texts:
        index = token_counts.Prefixes.unpack(own.index(t).pack())
        want = [count(t[:n]) for n in range(len(t) + 1)]
        assert index.counts.tolist() == want and own.index(t).total == want[-1], t
    run = "".join(chr(97 + k * k * k % 26) for k in range(3000))
    df = spark.createDataFrame([(1, run), (2, "語" * 3000)], "doc_id long, text string")
    index = token_counts.count_documents(df, JSON)
    for r in token_counts.truncate_documents(df, index, JSON, 50).collect():
        whole = run if r.doc_id == 1 else "語" * 3000
        assert r.text and whole.startswith(r.text) and count(r.text) <= 50 < count(whole[: len(r.text) + 1])


@pytest.mark.parametrize("text, none", [("½ ² ① Ⅷ", True), ("12 _ 34", True), ("é", False), ("ª 1", False), ("日本", False), ("Ⅷa", False), (" \n", True)])
def test_language_id_letters(text, none):
    model = language_id.Model(["en", "fr"], {"w": (["a"], language_id.np.ones((1, 2)))})
    assert (model.predict(text)[0] == "und") == none == (not any(map(str.isalpha, text)))
    assert set("".join(language_id.words(text))) == {c for c in text.lower() if c.isalpha()}
