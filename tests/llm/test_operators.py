"""The ten operators: brute force on small tables, and the defined edge cases."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, byteops, fingerprint, langid, minhash, packing, ppm, quality, queries, substring, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re") for b in ("ban", "dor", "fil", "gus") for c in ("", "s", "t")]


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


LONG = prose(99, 30_000)
#: Nulls, empty and blank texts, ties, repeated rows, odd characters, a very long text.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "Straße 日本 😀 ÀÉ \x1c x"), (7, prose(1, 200)), (7, prose(1, 200)),
    (8, prose(1, 200)), (9, "line\nline\nline\n\n\nline"), (None, "no id"), (None, None), (10, LONG), (11, prose(2, 60) + "\n" + prose(3, 60)), (12, "it's we'll   'tis\r\n<|endoftext|> x"), (-5, "a b c a b c a b c"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "xx", "s", "clash") for i, t in EDGES], "doc_id long, text string, lang string, source string, h string")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_every_query_handles_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(queries.QUERIES) == 10
    for name, run in queries.QUERIES.items():
        assert run(spark, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    import duckdb

    found = queries.QUERIES[name](spark, sf_dir).toArrow()
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(found.column_names)
    assert columns == sorted(want.column_names)
    plain = [sorted(zip(*(t.column(c).to_pylist() for c in columns), strict=True), key=repr) for t in (found, want)]
    assert plain[0] == plain[1]


# -- byte work ---------------------------------------------------------------------------


def test_words_and_hashes():
    column = pa.array([t for _, t in EDGES])
    for lo, hi, buf, off in byteops.slices(column, 500):
        starts, ends, bounds = byteops.words(buf, off)
        hashes = byteops.word_hashes(buf, starts, ends)
        raw, found = buf.tobytes(), {}
        for i in range(hi - lo):
            got = [raw[a:b].decode() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]])]
            assert got == words(EDGES[lo + i][1])
            for w, h in zip(got, hashes[bounds[i] : bounds[i + 1]].tolist()):
                assert found.setdefault(w, h) == h
        assert len(set(found.values())) == len(found)


# -- 7 and 8 -----------------------------------------------------------------------------


def test_bpe_matches_the_library_and_round_trips(spark, edges):
    import public_tokenizers as P
    import tiktoken

    tokens = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = rows_of(bpe.round_trip(edges, P.path("byte_bpe_50k.tiktoken")), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in EDGES:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    encoded = bpe.encode(edges, P.path("byte_bpe_50k.tiktoken"))
    assert "h" in encoded.columns
    back = bpe.decode(encoded.drop("text"), P.path("byte_bpe_50k.tiktoken"))
    assert rows_of(back, "doc_id", "text") == sorted(((i, t or "") for i, t in EDGES), key=repr)


def test_perfect_hash_is_minimal():
    keys = byteops.mix(np.arange(5000, dtype=np.uint64))
    assert sorted(bpe.PerfectHash(keys)(keys).tolist()) == list(range(5000))


def brute_check_packing(docs, pieces, tasks):
    """Every id in one piece, gapless sequences, tiers, step groups; returns padding."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    streams = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]) for i, t in docs]
    by_id = {}
    for i, ids in streams:
        by_id.setdefault((i, len(ids)), set()).add(tuple(ids))
        for at in range(len(ids)):
            want[i, len(ids), at] += 1
    got, by_sequence = Counter(), {}
    for p in pieces:
        assert any(crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for ids in by_id[p.doc_id, p.doc_tokens])
        for at in range(p.start, p.start + p.length):
            got[p.doc_id, p.doc_tokens, at] += 1
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert got == want
    padding, short, groups = 0, 0, {}
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert len({(p.tier, p.step_group) for p in own}) == 1 and own[0].tier in packing.TIERS and at <= own[0].tier
        short += at < own[0].tier
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
        groups.setdefault(own[0].step_group, []).append(own[0].tier)
    assert short <= tasks
    # Groups are numbered without gaps, of one tier each, and full but for the last of a tier.
    assert sorted(groups) == list(range(len(groups))) and all(len(set(g)) == 1 for g in groups.values())
    assert sum(sum(g) != packing.STEP_TOKENS for g in groups.values()) <= len({g[0] for g in groups.values()})
    return padding


def test_packing(spark, edges):
    import public_tokenizers as P

    found = packing.pack(edges, P.path("byte_bpe_50k.json")).collect()
    tasks = edges.rdd.getNumPartitions()
    assert brute_check_packing(EDGES, found, tasks) <= packing.WINDOW * tasks


@pytest.mark.parametrize("pool", [1, 3000, 1 << 20])
def test_packing_keeps_documents_whole(spark, monkeypatch, pool):
    import public_tokenizers as P

    monkeypatch.setattr(packing, "POOL", pool)
    monkeypatch.setattr(packing, "STEP_TOKENS", 2 * packing.WINDOW)
    rng = np.random.default_rng(5)
    docs = [(i, prose(3000 + i, int(rng.choice([5, 40, 90, 180, 400, 900])))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = packing.pack(df, P.path("byte_bpe_50k.json")).collect()
    assert brute_check_packing(docs, found, 1) <= packing.WINDOW
    pieces = Counter(p.doc_id for p in found)
    if pool == 1 << 20:
        # A sequence is closed by one cut at most, and a long document gives whole windows; most others fit whole.
        fit = [p.doc_id for p in found if p.start == 0 and p.doc_tokens <= packing.WINDOW]
        windows = sum(p.length == packing.WINDOW for p in found)
        assert len(found) <= len(docs) + windows + len({p.sequence_id for p in found})
        assert sum(pieces[i] == 1 for i in fit) > 0.7 * len(fit)
        stated = packing.cuts(spark.createDataFrame(found)).collect()
        assert sum(r.documents for r in stated) == len(docs) and sum(r.pieces for r in stated) == len(found)
        assert sum(r.whole for r in stated) == sum(n == 1 for n in pieces.values())


def test_packing_places_best_fits():
    def packed(lengths):
        packer = packing.Packer(3)
        for i, n in enumerate(lengths):
            packer.add(i, bytes(4 * n))
        packer.close(0)
        return {(r[0], r[1], r[2], r[5] & 0xFF, r[6], r[7]) for r in packer.rows}

    # The gap of 148 takes the pair 100 + 48 and not the longer 120; the rest opens a shorter tier.
    assert packed([1900, 120, 100, 48]) == {(0, 0, 1900, 0, 0, 2048), (2, 0, 100, 0, 1900, 2048), (3, 0, 48, 0, 2000, 2048), (1, 0, 120, 1, 0, 256)}
    # The rest of the document beyond the window does not fit the gap of 548, and is cut for it.
    assert {(0, 0, 1500, 2, 0, 2048), (1, 0, 2048, 0, 0, 2048), (1, 4096, 548, 2, 1500, 2048), (1, 4644, 356, 3, 0, 512)} <= packed([1500, 5000])
    assert packed([2048, 256, 1]) == {(0, 0, 2048, 0, 0, 2048), (1, 0, 256, 1, 0, 256), (2, 0, 1, 2, 0, 256)}


# -- 9 -----------------------------------------------------------------------------------


def test_language_identification(spark, edges):
    letters = {"aa": "abcde", "bb": "vwxyz"}
    rng = np.random.default_rng(0)

    def sample(lang):
        return " ".join("".join(rng.choice(list(letters[lang]), 4)) for _ in range(30))

    docs = spark.createDataFrame([(i, sample(lang), lang) for i, lang in enumerate(["aa", "bb"] * 20)], "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    assert set(profiles) == {"aa", "bb"} and all(len(p) <= langid.PROFILE for p in profiles.values())
    assert all(r.lang_pred == r.lang for r in langid.predict(docs, profiles).collect())
    found = langid.predict(edges.withColumn("lang_pred", F.lit("clash")), profiles).collect()
    assert len(found) == len(EDGES)
    for r in found:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.lang_score <= 1
    assert {r.lang_pred for r in langid.predict(edges, {}).collect()} == {"und"}


def test_frequent_ngrams_keep_their_order():
    """Counts beyond 2 ** 22 are told apart."""
    text = "b" * (1 << 23) + " " + "ab" * (1 << 22)
    profile = langid.Ranker({"x": [0x62, 0x61]})
    for _, _, buf, off in byteops.slices(pa.array([text])):
        _, score = profile(buf, off)
    # b, bb, bbb, a, ab, ba, then the rest, by falling count.
    _, gram, count = langid.gram_counts(buf, off)
    order = [g for _, g in sorted(zip((-count).tolist(), gram.tolist())) if g not in {0x5F, 0x5F5F, 0x5F5F5F}]
    apart = abs(0 - order.index(0x62)) + abs(1 - order.index(0x61)) + langid.PROFILE * (len(order) - 2)
    assert score[0] == pytest.approx(1 - apart / len(order) / langid.PROFILE)


def test_rank_distance_by_brute_force():
    texts = [prose(5, 50), "Ab, ab! 12 cd", "é à é"]
    profiles = {"p": list(range(0x616161, 0x616161 + 50)) + [0x61, 0x62], "q": [0x5F61, 0x6162, 0x6B61]}
    column = pa.array(texts)
    ranker = langid.Ranker(profiles)
    for _, _, buf, off in byteops.slices(column):
        best, score = ranker(buf, off)
    gap = {0x5F, 0x5F5F, 0x5F5F5F}
    for text, b, s in zip(texts, best, score):
        seen = bytes(langid._SEEN[x] for x in text.encode())
        seen = re.sub(rb"_+", b"_", b"_" + seen + b"__")
        counts = Counter()
        for i in range(len(seen)):
            for n in (1, 2, 3):
                counts[int.from_bytes(seen[i : i + n].ljust(n, b"_"), "big")] += 1
        top = sorted((g for g in counts if g not in gap), key=lambda g: (-counts[g], g))[: langid.PROFILE]
        far = {name: sum(abs(p.index(g) - r) if g in p else langid.PROFILE for r, g in enumerate(top)) / len(top) / langid.PROFILE for name, p in profiles.items()}
        assert ranker.names[b] == min(far, key=lambda x: (far[x], x))
        assert s == pytest.approx(1 - min(far.values()))


# -- 1 -----------------------------------------------------------------------------------


def test_toxicity(spark, edges):
    bad = ["grumble", "snarl", "vileness"]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        own = prose(1000 + i, 80).split()
        if i % 5 == 0:
            for _ in range(4):
                own.insert(int(rng.integers(0, 80)), bad[int(rng.integers(0, 3))])
        rows.append((i, " ".join(own), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None), (7, 0)], "doc_id long, toxic int"))
    model = toxicity.learn(docs.drop("toxic"), labels)
    assert len(model["forms"]) <= toxicity.LEXICON
    scored = toxicity.predict(docs, model).collect()
    assert all(r.toxic_predicted == r.toxic == int(r.toxic_score >= 0.7) for r in scored)
    odd = toxicity.predict(edges.withColumn("toxic_score", F.lit("clash")), model).collect()
    assert len(odd) == len(EDGES) and all(0 <= r.toxic_score <= 1 for r in odd)
    assert toxicity.learn(docs.drop("toxic"), labels.where("toxic = 0")) is None
    assert {r.toxic_score for r in toxicity.predict(edges, None).collect()} == {0.0}


def test_label_model_trusts_better_voters():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.2
    v = np.stack([np.where(rng.random(2000) < a, y, rng.random(2000) < 0.05) for a in (0.95, 0.9, 0.85, 0.3)] + [y], axis=1).astype(float)
    q, rates = toxicity.label_model(v)
    assert ((q > 0.5) == y).mean() > 0.98
    assert rates[1][0] > rates[1][3]


# -- 2 -----------------------------------------------------------------------------------


def naive_vector(text):
    """Lanes as the module defines them, hashes taken from Spark's xxhash64 through ``hashes``."""
    return [(p, [(w, prev) for w, prev in zip(p.split(" "), ["", *p.split(" ")])]) for p in text.split("\n")]


def test_fingerprints(spark, edges, monkeypatch):
    monkeypatch.setattr(fingerprint, "HOT", 1)  # rows of a repeated id go to several keys
    docs = [(i, t or "") for i, t in EDGES]
    found = fingerprint.fingerprints(edges).collect()
    assert len(found) == len(EDGES)
    order = sorted({fingerprint.LAST_ID if i is None else i for i, _ in docs})
    texts = {i: [t for j, t in docs if (fingerprint.LAST_ID if j is None else j) == i] for i in order}
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in docs}], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    head = {i: min(texts[i], key=hashes.get) for i in order}
    want = []
    for i, t in docs:
        own = fingerprint.LAST_ID if i is None else i
        nxt = order[(order.index(own) + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + head[nxt][:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), None if nxt == fingerprint.LAST_ID else nxt, edited, head[nxt]))
    assert rows_of(spark.createDataFrame(found), "doc_id", "n_chars", "edited_sha256", "next_doc_id") == sorted((w[:4] for w in want), key=repr)
    # Equal texts have equal fingerprints wherever they stand, and no others have.
    by_sha = {}
    for (i, t), w in zip(docs, want):
        for r in found:
            if (r.doc_id, r.n_chars, r.edited_sha256) == (w[0], w[1], w[2]):
                by_sha.setdefault(hashlib.sha256(t.encode()).hexdigest(), set()).add(r.fingerprint)
                by_sha.setdefault(w[2], set()).add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_sha.values()) and len({next(iter(v)) for v in by_sha.values()}) == len(by_sha)


def test_fingerprint_likeness_by_brute_force(spark):
    """near_edited and near_next against lanes counted one shingle at a time."""
    docs = [(i, "\n".join(prose(700 + 10 * i + k, 30 + 7 * i) for k in range(3))) for i in range(12)] + [(30, ""), (31, "a"), (32, "a  b\n\nc")]
    docs += [(40, docs[3][1] + " tail"), (41, docs[3][1])]
    found = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    pairs = set()
    order, text = [i for i, _ in docs], dict(docs)
    edited = {}
    for k, i in enumerate(order):
        half = len(text[i]) // 2
        edited[i] = text[i][: len(text[i]) - half] + text[order[(k + 1) % len(order)]][:half]
    for t in [*text.values(), *edited.values()]:
        pairs |= {u for _, units in naive_vector(t) for u in units}
    table = {(r.x, r.y): r.h for r in spark.createDataFrame(sorted(pairs), "x string, y string").select("x", "y", F.xxhash64("x", "y").alias("h")).collect()}

    def lanes(t):
        counts = Counter(table[u] % fingerprint.SIM_LANES for _, units in naive_vector(t) for u in units)
        return np.array([counts[k] for k in range(fingerprint.SIM_LANES)], float)

    def like(s, t):
        a, b = lanes(s), lanes(t)
        if sorted(s.split("\n")) == sorted(t.split("\n")):
            return 1.0
        square = lambda v: (v * v).sum() - v.sum() ** 2 / fingerprint.SIM_LANES
        total = square(a) + square(b)
        return min(1.0, max(0.0, 1 - square(a - b) / total)) if total > 0 else 0.0

    for k, i in enumerate(order):
        assert found[i].near_edited == pytest.approx(like(text[i], edited[i])), i
        assert found[i].near_next == pytest.approx(like(text[i], text[order[(k + 1) % len(order)]])), i
    assert found[40].near_next > 0.9 and found[0].near_next < 0.5


def test_fingerprints_are_homomorphic(spark):
    texts = spark.createDataFrame([(1, "a b c\nd e\nf"), (2, "f\na b c\nd e"), (3, "a b c\nf"), (4, "d e")], "k int, text string")
    v = texts.select("k", fingerprint.vector(F.col("text")).alias("v"))
    shown = {r.k: r.t for r in v.select("k", fingerprint.as_text(F.col("v")).alias("t")).collect()}
    assert shown[1] == shown[2] != shown[3]
    one = v.groupBy().pivot("k", [1, 3, 4]).agg(F.first("v"))
    added = fingerprint.combine(F.col("3"), F.col("4"))
    r = one.select(fingerprint.as_text(added).alias("a"), fingerprint.as_text(fingerprint.combine(added, F.col("4"), -1)).alias("d")).first()
    assert r.a == shown[1] and r.d == shown[3]


def test_neighbours(spark):
    values = [0, 1, 5, 4095, 4096, 20_000_000, 10**13, -7]
    table = spark.createDataFrame([(v, 2 * i) for i, v in enumerate(values)], "_id long, _most long")
    found = {r._id: (r._prev, r._need) for r in fingerprint.neighbours(table).collect()}
    order, most = sorted(values), {v: 2 * i for i, v in enumerate(values)}
    assert found == {v: (order[k - 1], most[order[k - 1]]) for k, v in enumerate(order)}


# -- 3 -----------------------------------------------------------------------------------


def naive_ppm(grams, context, symbol):
    """log10 probability by PPM with method D and exclusion, straight from the definition."""
    excluded, out = set(), 0.0
    for o in range(ppm.ORDER, -1, -1):
        suffix = context[len(context) - o :]
        counts = Counter()
        for g, c in grams.items():
            if g[ppm.ORDER - o : ppm.ORDER] == suffix:
                counts[g[-1]] += c
        seen = set(counts)
        counts = {s: c for s, c in counts.items() if s not in excluded}
        total = sum(counts.values())
        if total:
            if symbol in counts:
                return out + math.log10((counts[symbol] - 0.5) / total)
            out += math.log10(len(counts) / 2 / total)
        excluded |= seen
    return out - math.log10(256 - len(excluded))


@pytest.mark.parametrize("block", [10, 12 << 20])
def test_ppm_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", block)
    docs = [(i, t) for i, t in enumerate(["the cat sat", "the cat ran", "a dog sat down", "The Dog", "zebra the", "cat cat dog", None, "", "  x  "])]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: words((t or "").translate(low)) for i, t in docs}
    held = {i: crc32(str(i).encode()) % 7 == 2 for i, _ in docs}

    def symbols(i):
        s = b"\n" * ppm.ORDER + " ".join(tokens[i]).encode() + b"\n"
        return [s[k : k + ppm.ORDER + 1] for k in range(len(s) - ppm.ORDER)]

    grams, counts = Counter(), Counter()
    for i in tokens:
        if not held[i]:
            grams.update(symbols(i))
            counts.update([*tokens[i], "\n"])
    n, v = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in ppm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(found) == len(docs)
    for i in tokens:
        r = found[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(tokens[i]) + 1, n)
        assert r.n_known == sum(counts[t] > 0 for t in [*tokens[i], "\n"])
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in [*tokens[i], "\n"]))
        assert r.score == pytest.approx(sum(naive_ppm(grams, g[:-1], g[-1]) for g in symbols(i)))


def test_ppm_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 102, 300).astype(np.uint8))
    buf = np.frombuffer(text, np.uint8)
    keys, _, _, _ = ppm.stream(buf, np.array([0, len(buf)]))
    triples = np.unique(keys & np.uint64(0xFFFFFF), return_counts=True)
    context = keys[50] >> np.uint64(8)
    every = np.unique(np.concatenate((keys, (context << np.uint64(8)) | np.arange(256, dtype=np.uint64))))
    count = np.array([int((keys == k).sum()) for k in every])
    cost = ppm.price(every, count, triples)
    assert (10 ** cost[every >> np.uint64(8) == context]).sum() == pytest.approx(1.0)


def test_ppm_edges(spark, edges):
    assert ppm.score(edges).count() == len(EDGES)
    alone = ppm.score(spark.createDataFrame([(2, "ab")], "doc_id long, text string").where(langid.held_out(crc32(b"2") % 7, 7)), crc32(b"2") % 7, 7).first()
    assert alone.score == pytest.approx(-3 * math.log10(256)) and alone.train_tokens == 0


# -- 4 -----------------------------------------------------------------------------------


def test_quality_by_brute_force(spark, edges):
    clashing = edges.withColumns({c: F.lit("mine") for c in ("n_words", "_words", "_LINES", "_windows", "_repeats", "a.b")})
    book = quality.ledger(clashing).collect()
    assert len(book) == len(EDGES) and {(r["_words"], r["_LINES"], r["_windows"], r["_repeats"], r["a.b"]) for r in book} == {("mine",) * 5}
    for r in book:
        t = r.text or ""
        w = words(t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert (r.fail_bits & quality.mask(quality.BASE) != 0) == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_ablation(spark):
    book = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "fail_bits long")
    found = {(r.version, r.rule): (r.documents, r.rejected, r.failed, r.only) for r in quality.ablation(book, {1: quality.BASE}).collect()}
    assert found == {(1, "few_words"): (5, 3, 3, 2), (1, "repeated_windows"): (5, 3, 1, 0)}
    assert {r.k for r in book.select(quality.verdict("fail_bits", quality.BASE).alias("k")).where("k").collect()} == {True}


# -- 5 -----------------------------------------------------------------------------------


def shingle_set(text, k):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(docs, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in docs if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: root(i) for i in up}


def edited(text, n, seed):
    rng = np.random.default_rng(seed)
    w = text.split()
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


@pytest.mark.parametrize("block", [1000, 8])
def test_near_duplicates_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    base = prose(7, 120)
    docs = [(i, t) for i, t in EDGES if t != LONG]
    docs += [(100 + i, edited(base, i % 9, i)) for i in range(40)] + [(200 + i, prose(500 + i, 40)) for i in range(10)] + [(300, base.upper())]
    found = minhash.groups(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=85).collect()
    want = brute_groups(docs, 3, 85)
    assert len(found) == len(docs)
    for r in found:
        assert r.component_id == want.get(r.doc_id)
    kept = minhash.deduplicate(spark.createDataFrame([(i, t, "c", "d") for i, t in docs], "doc_id long, text string, n string, _r string"), k=3, percent=85)
    assert kept.columns == ["doc_id", "text", "n", "_r"] and {r["_r"] for r in kept.collect()} == {"d"}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, r in want.items() if i == r)
    assert kept.where("doc_id IS NULL").count() == 2


def test_large_family_of_unlike_texts(spark, monkeypatch):
    """A family that bands chain together is decided band by band."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    base = prose(9, 100)
    # Each text keeps part of the one before, so neighbours are alike and the ends are not.
    docs, own = [], base.split()
    for i in range(40):
        docs.append((i, " ".join(own)))
        own = own[2:] + prose(4000 + i, 2).split()
    docs += [(100 + i, edited(base, 3, 50 + i)) for i in range(20)]
    found = minhash.groups(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_groups(docs, 3, 85)


def test_signatures_by_chunks(monkeypatch):
    h = np.sort(byteops.mix(np.arange(500, dtype=np.uint64)))
    whole = minhash.signatures(h, np.array([0, 200, 200, 500]))
    monkeypatch.setattr(minhash, "CHUNK", 37)
    assert (minhash.signatures(h, np.array([0, 200, 200, 500])) == whole).all()


def test_superminhash_estimates_similarity():
    for common in (20, 60, 100):
        a = byteops.mix(np.arange(100 + common, dtype=np.uint64))
        x, y = np.sort(a[:100]), np.sort(a[100 - common + 0 :][:100]) if common < 100 else np.sort(a[:100])
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        values = minhash.signatures(np.concatenate((x, y)), np.array([0, 100, 200]))
        assert abs((values[0] == values[1]).mean() - true) < 0.16
    one = minhash.signatures(a[:1], np.array([0, 1]))
    assert np.isfinite(one).all() and sorted(np.floor(one[0]).tolist()) == list(range(minhash.SLOTS))


# -- 6 -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + prose(4, 100) + "</p>"
    rows = [(5, "http://a/", big), (3, "http://b/ x\n", big), (9, None, big), (None, "u", big), (1, "http://c/é", ""), (2, "d", None), (4, "e", "short"), (6, "f", "short"), (7, "g", "h\r\n\r\nWARC/1.1 body " * 20), (8, "z", "é" * 60)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")


def test_warc_round_trip(spark, pages):
    found = {r.page_id: r for r in warc.archive_and_read(pages).collect()}
    assert len(found) == pages.count()
    first = {}
    for r in pages.collect():
        b = (r.html or "").encode()
        if len(b) >= 100 and r.page_id is not None:
            first[b] = min(first.get(b, r.page_id), r.page_id)
    for r in pages.collect():
        b, f = (r.html or "").encode(), found[r.page_id]
        refers = first.get(b) if first.get(b) != r.page_id else None
        assert (f.payload_bytes, f.payload_digest, f.refers_to) == (len(b), hashlib.sha256(b).hexdigest(), refers)
        assert f.record_type == ("revisit" if refers is not None else "response") and f.intact in (True, None)


@pytest.mark.parametrize("size", [1, 37, 1000, 1 << 20])
def test_warc_ranges_find_every_record_once(spark, size, tmp_path):
    inner = warc.record(77, "in", b"nested", hashlib.sha256(b"nested").hexdigest(), None)
    bodies = [b"a" * 10, b"\x1f\x8b\x08 false magic", b"", b"x" * 5000, b"\x1f\x8b\x08" * 50]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(warc.record(i, "u", b, hashlib.sha256(b).hexdigest(), None) for i, b in enumerate(bodies)) + b"junk\x1f\x8b\x08junk" + inner)
    data = path.read_bytes()
    if size == 1:
        data = data[:400]
        path.write_bytes(data)
    got = []
    with path.open("rb") as f:
        for start in range(0, len(data), size):
            got += list(warc.members(f, start, min(len(data), start + size)))
    with path.open("rb") as f:
        whole = list(warc.members(f, 0, len(data)))
    assert got == whole and (size == 1 or len(whole) == len(bodies) + 1)


@pytest.mark.parametrize("size", [50, 333, 1000, 4096, 1 << 20])
def test_warc_records_inside_stored_records_are_not_records(spark, size, tmp_path):
    import zlib

    def stored(page, payload):
        """A record as a member whose payload stands in the file as it is."""
        plain = zlib.decompress(warc.record(page, "u", payload, hashlib.sha256(payload).hexdigest(), None), 31)
        squeeze = zlib.compressobj(0, zlib.DEFLATED, 31)
        return squeeze.compress(plain) + squeeze.flush()

    def plain(page, n):
        payload = prose(page, n).encode()
        return warc.record(page, "u", payload, hashlib.sha256(payload).hexdigest(), None)

    nested = b"".join(plain(100 + i, 50 + 40 * i) for i in range(6))
    whole = plain(1, 30) + stored(2, nested) + plain(3, 300) + stored(4, stored(5, nested) + nested) + b"junk" + plain(6, 10)
    (tmp_path / "a.warc.gz").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(stored(7, nested * 3))
    files = spark.createDataFrame([(f"{tmp_path}/a.warc.gz", len(whole), 1), (f"{tmp_path}/b.warc.gz", (tmp_path / "b.warc.gz").stat().st_size, 2)], "path string, bytes long, start int")
    found = sorted(r.page_id for r in warc.read(spark, files, range_bytes=size).collect())
    assert found == [1, 2, 3, 4, 6, 7]


def test_warc_hot_payloads_and_long_html(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 2)
    rows = [(i, "u", "<p>common page</p>" * 10) for i in range(40, 10, -1)] + [(i, None, None) for i in range(100, 130)] + [(5, "long", LONG * 5), (6, "long", LONG * 5)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, salt string")
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect()}
    assert len(found) == len(rows) and found[5] == ("response", None) and found[6] == ("revisit", 5)
    for i, _, html in rows[:-2]:
        assert found[i] == (("revisit", 11) if html and i != 11 else ("response", None))


# -- 10 ----------------------------------------------------------------------------------


def brute_removal(docs):
    starts = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - 49):
            if i is not None:
                starts.setdefault(tuple(w[p : p + 50]), set()).add(i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and min(starts[tuple(w[p : p + 50])]) < i:
                gone |= set(range(p, p + 50))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def repeating_documents():
    passage, other = prose(21, 55), prose(22, 120)
    docs = [d for d in EDGES if d[0] != 10] + [(20 + i, f"{prose(30 + i, 20)} {passage} {prose(60 + i, 20)}") for i in range(6)]
    docs += [(40, other), (41, other + " tail"), (42, "head " + " ".join(other.split()[10:100])), (43, " ".join(other.split()[:49])), (44, " ".join(other.split()[:50])), (45, "x " * 300), (46, "x " * 120), (12, passage)]
    # Periodic texts, copies with one word changed, passages that meet in other orders.
    docs += [(50, "x y " * 200), (51, "a " + "y x " * 60), (52, edited(other, 1, 5)), (53, f"{passage} {other} {passage}"), (54, f"{other} {passage}"), (55, f"{other} {other}"), (3, f"{passage} late")]
    return docs


def test_substring_removal_by_brute_force(spark):
    docs = repeating_documents()
    found = substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), digest_only=True)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_removal(docs)


def test_substring_removal_from_long_texts(spark):
    w = LONG.split()
    docs = [(10, LONG), (4, " ".join(w[20_000:20_060])), (11, "new " + LONG + " end"), (12, " ".join(w[5_000:6_000] + w[100:400])), (13, "z " * 5_000), (14, "z " * 3_000 + LONG[:3_000])]
    found = substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), digest_only=True)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_removal(docs)


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring, "BITS", 64)
    docs = repeating_documents()
    found = substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), digest_only=True)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_removal(docs)


def test_nonbranching_runs_compact_to_one_path(spark):
    """A copy is one span, and a text that parts in the middle is a path before and a path after."""
    whole = prose(5, 1500)
    w = whole.split()
    texts = spark.createDataFrame([(1, 11, whole), (2, 22, whole), (3, 33, " ".join(w[:700] + ["other"] + w[701:]))], "doc long, h long, text string")
    spans = {(r.doc, r.s, r.e, r.sdoc, r.ss) for r in substring.spans_of(texts.where("doc < 3")).collect()}
    assert spans == {(2, 0, 1500, 1, 0)}
    spans = substring.spans_of(texts).collect()
    covered = {d: sorted({j for r in spans if r.doc == d for j in range(r.s, r.e)}) for d in (2, 3)}
    assert covered[2] == list(range(1500)) and covered[3] == [j for j in range(1500) if j != 700]
    assert len([r for r in spans if r.doc == 2]) <= 6 and all(r.s == r.ss and r.sdoc == 1 for r in spans)


def test_a_span_goes_only_if_its_words_are_its_sources():
    """Where hashes lie, the words at the source's coordinates decide."""
    docs = [(1, prose(1, 60)), (2, prose(2, 60)), (3, prose(1, 60))]
    raw = docs[0][1].encode()
    starts, ends, _ = byteops.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    digest = substring._digest(raw, starts, ends, 0, 60)
    for (_, t), gone in zip(docs, (60, 0, 60)):
        own = t.encode()
        s, e, _ = byteops.words(np.frombuffer(own, np.uint8), np.array([0, len(own)]))
        assert substring._cut(own, [{"s": 0, "e": 60, "digest": digest}], s, e)[0] == gone


def test_substring_keeps_other_columns(spark, edges):
    clashing = edges.withColumns({c: F.lit("mine") for c in ("n_words", "_doc", "_H", "_spans", "_runs", "_dh", "a.b")})
    found = substring.remove_repeats(clashing)
    assert found.columns == [*[c for c in clashing.columns if c != "n_words"], "n_words", "n_removed", "kept_text"] and found.count() == len(EDGES)
    assert {(r["_doc"], r["_H"], r["_spans"], r["_runs"], r["_dh"], r["a.b"], r["h"]) for r in found.collect()} == {("mine",) * 6 + ("clash",)}


def test_components(spark):
    from quire.llm import components

    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    edges = [(i + 1, i) for i in range(0, 30)] + [(100, 90), (90, 95), (95, 100), (200, 200), (7, 3), (7, 3)] + [(500, 300 + i) for i in range(20)]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    del up[200]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == up and len(found) == len(up)


def test_measured_recall_of_bands(sf_dir):
    import pyarrow.parquet as pq

    from tests.llm.recall import measure

    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column("text").combine_chunks()
    for k, percent in ((3, 85), (5, 80)):
        above, shared = measure(texts, k, percent)
        assert above > 0 and shared >= 0.9 * above
