"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

* Forms. A text's forms are its words (runs of letters, lower case) and the
  proper beginnings of its words. Forms that labelled training texts of the
  toxic class have far more often make up the lexicon, at most ``LEXICON``.
* Voters. The lexicon is dealt into ``GROUPS`` lexicon voters, a form and its
  neighbours in rank to different voters; pattern voters look at shouting,
  exclamation and the share of words in the lexicon; annotators' labels are a voter
  too. A voter fires or not.
* Label model. A generative model of two latent classes. Each voter fires with
  a rate per class (its accuracy and coverage); where voters fire together
  more than the classes explain, they are joined in a tree, and a voter's rate
  depends on its parent's vote too: those rates are the correlations. The tree
  is the forest of greatest mutual information given the class (Chow and
  Liu), with the edges that pay for their parameters (BIC). All of it is
  estimated by expectation maximization over the counts of vote patterns of
  all training texts. On a text without a label the annotators abstain.
* Classifier. Logistic regression on lexicon counts and patterns, trained on
  the label model's posteriors, by Newton steps with an L2 penalty.

Forms are counted over all labelled training texts and votes over all training
texts. Only toxic texts and one in ``PART`` of the others are shuffled to their
labels. The forms that pass there are broadcast: a form passes only with ``pos // 400`` toxic
texts, so that they do not grow with the input. Other texts cannot raise a
form's rate; they are not shuffled, but send the forms of that list that they have,
and these are counted whole before the lexicon is chosen.
The logistic regression alone is bounded: it sees at most ``FIT_ROWS``
labelled training texts, chosen by a hash of doc_id. Scoring is one pass over all texts without a shuffle, with the lexicon
and weights broadcast (bounded by LEXICON).

Defined cases: a null, empty or letterless text has no forms and gets the
score of no evidence. Without labels of both classes every score is 0. Null
labels, null ids and held-out rows teach nothing; of several labels of one
doc_id the largest counts. Repeated rows are scored each. Columns that the
operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import byteops as B
from quire.llm.columns import map_arrow, named, own
from quire.llm.langid import held_out
from quire.llm.memory import returning
from quire.llm.substring import bloom, held, sift
from quire.session import materialize

#: Labelled texts that the logistic regression sees at most.
FIT_ROWS = 12_000
#: One in so many labelled texts that are not toxic is counted beside the toxic ones, before the rest.
PART = 16
#: Forms in the lexicon at most.
LEXICON = 512
GROUPS = 16
#: Bytes of the word beginnings that count as forms.
STEMS = (4, 5, 6, 7, 8, 9, 10, 12)
#: The last three ask what share of a text's words has a form in the lexicon: per thousand words.
PATTERNS = ("shouting", "exclaiming", "share 4", "share 8", "share 12")
SHARES = (4, 8, 12)
THRESHOLD = 0.7
PLAIN = ("letters", "capitals", "marks", "words", "hits")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


def _lower(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the capitals U+00C0 to U+00DE."""
    low = B.LOWER[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    second = low[at]
    capital = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    low[at[capital]] += 32
    return low


def forms(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, word, form hash) arrays: whole words, then word beginnings by length."""
    starts, ends, bounds = B.words(buf, off, _LETTER[buf])
    owner = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    low = _lower(buf) if len(buf) else buf
    spot = np.arange(len(starts))
    yield owner, spot, B.word_hashes(low, starts, ends)
    values = B._BYTE_CODE[low]
    for k in STEMS:
        longer = np.flatnonzero(ends - starts > k)
        s = starts[longer]
        yield owner[longer], longer, B.span_hash(values, s, s + k) ^ np.uint64(k)


def surface(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts x 4) counts: letters, capital letters, exclamation marks, words."""
    letter = _LETTER[buf]
    capital = (buf >= 0x41) & (buf <= 0x5A)
    out = []
    for flag in (letter, capital, buf == 0x21):
        total = np.concatenate(([0], np.cumsum(flag)))
        out.append(np.diff(total[off]))
    return np.stack([*out, np.diff(B.words(buf, off, letter)[2])], axis=1)


class Lexicon:
    """Counts lexicon forms in texts."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        size = 1 << max(16, (8 * len(hashes)).bit_length())
        self.low = np.uint64(size - 1)
        self.maybe = np.zeros(size, dtype=bool)
        self.maybe[(self.hashes & self.low).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``h`` forms of the lexicon are, and which."""
        near = np.flatnonzero(self.maybe[(h & self.low).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[near]
        return near[hit], at[hit]

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, form, count) of the lexicon forms found, and the plain counts: surface, then words that have a form."""
        found, hit_words, hit_texts = [], [], []
        for owner, spot, h in forms(buf, off):
            where, at = self.find(h)
            found.append(owner[where] * len(self.hashes) + at)
            hit_words.append(spot[where])
            hit_texts.append(owner[where])
        key, count = np.unique(np.concatenate(found), return_counts=True)
        _, first = np.unique(np.concatenate(hit_words), return_index=True)
        hits = np.bincount(np.concatenate(hit_texts)[first], minlength=len(off) - 1)
        return key // len(self.hashes), key % len(self.hashes), count, np.column_stack((surface(buf, off), hits))


def design(owner: np.ndarray, form: np.ndarray, count: np.ndarray, plain: np.ndarray, size: int) -> np.ndarray:
    """Features of texts: each form's share of the words, in hundredths and at most 1, then patterns."""
    letters, words = np.maximum(plain[:, 0], 1), np.maximum(plain[:, 3], 1)
    x = np.zeros((len(plain), size + len(PATTERNS)))
    x[owner, form] = np.minimum(1.0, 100.0 * count / words[owner])
    x[:, size] = 100 * plain[:, 1] > 30 * letters
    x[:, size + 1] = plain[:, 2] * 50 > letters
    for i, share in enumerate(SHARES):
        x[:, size + 2 + i] = 1000 * plain[:, 4] > share * words
    return x


def votes(x: np.ndarray, size: int, labels: np.ndarray) -> np.ndarray:
    """(texts x voters): the lexicon voters, the pattern voters, the annotators."""
    groups = np.arange(size) % GROUPS
    lexical = np.stack([(x[:, :size][:, groups == g] > 0).any(axis=1) for g in range(GROUPS)], axis=1)
    return np.concatenate((lexical, x[:, size:] > 0, labels[:, None] > 0), axis=1).astype(np.float64)


def _bits(v: np.ndarray) -> np.ndarray:
    """A number for each row of votes, without the annotators' vote."""
    return v[:, :-1].astype(np.int64) @ (1 << np.arange(v.shape[1] - 1))


def _unbits(bits: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The rows of votes of such numbers and labels (-1: none)."""
    lexical = bits[:, None] >> np.arange(GROUPS + len(PATTERNS)) & 1
    return np.concatenate((lexical, label[:, None] > 0), axis=1).astype(np.float64)


def _forest(gain: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent (-1: none) in the heaviest forest of edges above ``least``; ties go to smaller numbers."""
    m = len(gain)
    tree = np.arange(m)
    edges: list[list[int]] = [[] for _ in range(m)]
    a, b = np.triu_indices(m, 1)
    for i in np.lexsort((b, a, -gain[a, b])):
        x, y = int(a[i]), int(b[i])
        if gain[x, y] <= least:
            break
        if tree[x] != tree[y]:
            tree[tree == tree[y]] = tree[x]
            edges[x].append(y)
            edges[y].append(x)
    parent, done = np.full(m, -1), np.zeros(m, dtype=bool)
    for root in range(m):
        stack = [] if done[root] else [root]
        while stack:
            x = stack.pop()
            done[x] = True
            for y in edges[x]:
                if not done[y]:
                    parent[y] = x
                    stack.append(y)
    return parent


def _mutual(v: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mutual information of each two voters given the class, times the number of texts."""
    out = np.zeros((v.shape[1], v.shape[1]))
    for w in weights:
        total = w.sum() + 1e-9
        one = w @ v
        both = (v * w[:, None]).T @ v
        for x, y, joint in ((one, one, both), (one, total - one, one[:, None] - both), (total - one, one, one[None, :] - both), (total - one, total - one, total - one[:, None] - one[None, :] + both)):
            free = np.outer(x, y) / total
            out += np.where(joint > 1e-9, joint * np.log(np.maximum(joint, 1e-9) / np.maximum(free, 1e-12)), 0.0)
    return out


#: Rounds in which the forest may still change.
SHAPING = 8


def generative(v: np.ndarray, count: np.ndarray | None = None, known: np.ndarray | None = None, rounds: int = 60) -> dict:
    """The label model of votes (texts x voters): posterior, prior, rates, parent, given.

    A row stands for ``count`` texts. Where ``known`` is false, the last voter,
    who has no parent and no child, abstains. ``rates`` (2 x voters) are firing rates by class,
    ``given`` (2 x 2 x voters) those by class and the parent's vote.
    """
    n, m = v.shape
    count = np.ones(n) if count is None else count.astype(np.float64)
    cast = np.ones((n, m))
    if known is not None:
        cast[:, -1] = known
    v = v * cast
    start = np.clip(v.sum(axis=1) / cast.sum(axis=1) * 3, 0.02, 0.98)
    q = np.where(cast[:, -1] == 0, start, np.where(v[:, -1] > 0, np.maximum(start, 0.8), np.minimum(start, 0.3)))
    parent, rates, given, prior = np.full(m, -1), np.zeros((2, m)), np.zeros((2, 2, m)), 0.0
    for turn in range(rounds):
        prior = float(np.clip(np.average(q, weights=count), 1e-3, 0.5))
        weights = ((1 - q) * count, q * count)
        if turn < SHAPING:
            gain = _mutual(v[:, :-1], weights)
            # An edge has one rate more in each class.
            parent = np.append(_forest(gain, np.log(max(count.sum(), 2.0))), -1)
        above = np.where(parent >= 0, v[:, parent], 0.0)
        for c, w in enumerate(weights):
            rates[c] = np.clip((w @ v + 0.5) / (w @ cast + 1.0), 1e-3, 1 - 1e-3)
            for value, side in ((0, 1 - above), (1, above)):
                # Beside the counts, one text at the voter's own rate.
                seen = (w[:, None] * side * cast).sum(axis=0)
                given[c, value] = np.clip(((w[:, None] * side * v).sum(axis=0) + rates[c]) / (seen + 1.0), 1e-3, 1 - 1e-3)
            given[c] = np.where(parent >= 0, given[c], rates[c])
        odds = np.full(n, np.log(prior / (1 - prior)))
        for c, sign in ((1, 1.0), (0, -1.0)):
            p = np.where(above > 0, given[c, 1], given[c, 0])
            odds += sign * (cast * np.where(v > 0, np.log(p), np.log(1 - p))).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        moved, q = np.abs(new - q).max(), new
        if turn >= SHAPING and moved < 1e-6:
            break
    return {"posterior": q, "prior": prior, "rates": rates, "parent": parent, "given": given}


def label_model(v: np.ndarray, count: np.ndarray | None = None, known: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each row of votes, and the voters' rates (2 x voters)."""
    model = generative(v, count, known, rounds)
    return model["posterior"], model["rates"]


def logistic(x: np.ndarray, q: np.ndarray, penalty: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression on soft labels."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - q) + ridge * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _form_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that have a form, summed over a task's batches."""
    sums: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> list[tuple[np.ndarray, np.ndarray]]:
        key, where = np.unique(np.concatenate([k for k, _ in sums]), return_inverse=True)
        return [(key, np.stack([np.bincount(where, np.concatenate([c[:, i] for _, c in sums])) for i in (0, 1)], axis=1))]

    def flush() -> pa.RecordBatch:
        (key, count), = merged()
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count[:, 1].astype(np.int64)), pa.array(count[:, 0].astype(np.int64))], names=["form", "pos", "neg"])

    for batch in batches:
        toxic = B.longs(B.column(batch, "toxic"))
        for lo, hi, buf, off in B.slices(B.column(batch, "text")):
            owner, _, h = (np.concatenate(x) for x in zip(*forms(buf, off), strict=True))
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            if not len(h):
                continue
            new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
            h, label = h[new], toxic[lo:hi][owner[new]]
            edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            pos = np.add.reduceat(label, edge)
            sums.append((h[edge], np.stack((np.diff(np.append(edge, len(h))) - pos, pos), axis=1)))
        if sum(len(k) for k, _ in sums) > 4_000_000:
            sums[:] = merged()
            if len(sums[0][0]) > 2_000_000:
                yield flush()
                sums.clear()
    if sums:
        yield flush()


def _ranked(texts: DataFrame, known: DataFrame, pos: int, neg: int) -> np.ndarray:
    """The lexicon's forms (long ids and texts, labels): counted over all ``pos`` toxic and ``neg`` other labelled texts."""
    least = max(3, pos // 400)
    rate = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    early = (F.col("toxic") != 0) | (F.pmod(F.xxhash64("doc_id"), F.lit(PART)) == 0)

    def sieve(chosen: DataFrame):
        return bloom(chosen.select(F.col("doc_id").cast("long")))

    first, rest = known.where(early), known.where(~early)
    some = sift(texts, ["doc_id"], sieve(first)).join(first, "doc_id").select("text", "toxic").mapInArrow(returning(_form_counts), "form long, pos long, neg long").groupBy("form").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # What falls short already does so whatever the rest of the texts has: they only add to neg.
    likely = materialize(some.where((F.col("pos") >= least) & (rate > 2.5)), "forms")
    candidates = likely.select("form").toArrow().column("form").to_numpy().view(np.uint64)
    if not len(candidates):
        return candidates
    shared, wanted = texts.sparkSession.sparkContext.broadcast(candidates), sieve(rest)

    # Sifts and looks in one: a Python worker more for each task would take memory.
    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        size = len(lexicon.hashes)
        for batch in batches:
            batch = batch.filter(pa.array(held(batch.select(["doc_id"]), wanted.value)))
            ids = B.longs(B.column(batch, "doc_id"))
            for lo, hi, buf, off in B.slices(B.column(batch, "text")):
                found = []
                for owner, _, h in forms(buf, off):
                    where, at = lexicon.find(h)
                    found.append(owner[where] * size + at)
                key = np.unique(np.concatenate(found))
                owner, start = np.unique(key // size, return_index=True)
                if len(key):
                    off = pa.array(np.append(start, len(key)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][owner]), pa.ListArray.from_arrays(off, pa.array(lexicon.hashes[key % size].view(np.int64)))], names=["doc_id", "forms"])

    more = texts.mapInArrow(returning(having), "doc_id long, forms array<long>").join(rest.select("doc_id"), "doc_id").select(F.explode("forms").alias("form")).groupBy("form").agg(F.count("*").alias("more"))
    counts = likely.join(more, "form", "left").select("form", "pos", (F.col("neg") + F.coalesce("more", F.lit(0))).alias("neg"))
    best = counts.withColumn("rate", rate).where("rate > 2.5").orderBy(F.desc(F.col("rate") * F.sqrt(F.col("pos"))), "form").limit(LEXICON)
    return np.array([r["form"] for r in best.select("form").collect()], np.int64).view(np.uint64)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> dict | None:
    """The model: sorted lexicon hashes and classifier weights, or None without both classes."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(1, 3)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = materialize(known, "known")
    texts = docs.where(F.col("doc_id").isNotNull() & named(text).isNotNull() & ~held_out(1, 3)).select("doc_id", named(text).alias("text"))
    # Only labels of ids that have a text count.
    labelled = texts.select("doc_id").join(known, "doc_id")
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return None
    travelling = texts.withColumn("doc_id", F.col("doc_id").cast("long"))
    ranked = _ranked(travelling, known, pos, neg)
    if not len(ranked):
        return None
    shared = docs.sparkSession.sparkContext.broadcast(ranked)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            toxic, ids = B.longs(B.column(batch, "toxic")), B.column(batch, "doc_id")
            for lo, hi, buf, off in B.slices(B.column(batch, "text")):
                owner, form, count, plain = lexicon(buf, off)
                at = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(toxic[lo:hi]), pa.ListArray.from_arrays(pa.array(at), pa.array(form)), pa.ListArray.from_arrays(pa.array(at), pa.array(count.astype(np.int64))), *(pa.array(plain[:, i].astype(np.int64)) for i in range(5))],
                    names=["doc_id", "toxic", "form", "n", *PLAIN],
                )

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, size = Lexicon(shared.value), len(shared.value)
        for batch in batches:
            ids = B.column(batch, "doc_id")
            for lo, hi, buf, off in B.slices(B.column(batch, "text")):
                bits = _bits(votes(design(*lexicon(buf, off), size), size, np.zeros(hi - lo)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(bits)], names=["doc_id", "bits"])

    cast = travelling.mapInArrow(returning(vote), "doc_id long, bits long")
    # At most a row per pattern reaches the driver.
    patterns = cast.join(known, "doc_id", "left").groupBy("bits", F.coalesce("toxic", F.lit(-1)).alias("label")).agg(F.count("*").alias("n")).orderBy("bits", "label").toArrow()
    bits, label, n = (patterns.column(c).to_numpy() for c in ("bits", "label", "n"))
    posterior, _ = label_model(_unbits(bits, label), n, label >= 0)

    picked = labelled.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    sample = materialize(texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    # A bounded number of rows; put in one order here, so that sums come out alike whatever order tasks end in.
    seen = sample.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(returning(look), "doc_id long, toxic long, form array<long>, n array<long>, " + ", ".join(f"{c} long" for c in PLAIN)).toArrow()
    seen = seen.sort_by([("doc_id", "ascending"), ("toxic", "ascending"), *((c, "ascending") for c in PLAIN)])
    form = seen.column("form").combine_chunks()
    owner = np.repeat(np.arange(len(seen)), np.diff(form.offsets.to_numpy()))
    plain = np.stack([seen.column(c).to_numpy() for c in PLAIN], axis=1)
    x = design(owner, form.flatten().to_numpy(), seen.column("n").combine_chunks().flatten().to_numpy(), plain, len(ranked))
    toxic = seen.column("toxic").to_numpy()
    at = np.searchsorted(3 * bits + label, 3 * _bits(votes(x, len(ranked), np.zeros(len(x)))) + toxic)
    return {"forms": np.sort(ranked), "weights": logistic(x, posterior[at])}


def predict(docs: DataFrame, model: dict | None, text: str = "text", added: tuple[str, str] = ("toxic_score", "toxic_predicted")) -> DataFrame:
    """``docs`` with the score and the verdict (1 or 0) in the columns ``added``; they replace columns of those names."""
    docs = docs.select(*[named(c) for c in own(docs, *added)])
    if model is None:
        return docs.withColumn(added[0], F.lit(0.0)).withColumn(added[1], F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = Lexicon(shared.value["forms"]), shared.value["weights"]
        size = len(lexicon.hashes)
        for batch in batches:
            scores = [np.zeros(0)]
            for lo, hi, buf, off in B.slices(B.column(batch, text)):
                owner, form, count, plain = lexicon(buf, off)
                z = design(owner, form, count, plain, size) @ w[:-1] + w[-1]
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.IntegerType())])
    return map_arrow(docs, run, schema)
