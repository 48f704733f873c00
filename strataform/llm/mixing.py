"""Drawing texts so that every source has its target share of all tokens.

Documents belong to domains (the sources named in the targets) softly.  A
document that names its source belongs to it wholly.  One without a source
belongs to the domains by the posterior of a classifier that is trained on
labelled documents and calibrated on held-out ones.  However unsure the guess
is, the text takes part: its tokens count for each domain by its membership, and
the documents that name their source make up what is then missing.

Every distinct text gets a rate, how often it is drawn on average, between
zero and the number of repeats its domain allows.  The rates solve a least
squares problem, expected domain totals against targets, by projected
gradients: each step sums the totals over the distinct memberships, since texts
of one membership share a rate, and a rate follows from its membership and the
short history of domain errors, so that nothing per text is stored between
steps.  Few memberships (one a source where all are named) are summed on the
driver, many in a distributed pass.  Whole copies are drawn by a
hash of the text, with a last shift of the threshold per domain for the texts
that belong to it wholly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.functions.text import is_blank
from strataform.llm import tokens
from strataform.workspace import staged

#: Bound of the labelled rows the classifier is fitted on, and its feature count.
LABELLED_ROWS, FEATURES = 8192, 1024
#: The mix isn't made smaller than this part of the available tokens for the sake of a tiny source.
LEAST_SIZE = 0.25
#: A size is reached if each domain's expected tokens are within this part of its goal.
SLACK = 0.05
STEPS, BUCKETS = 40, 4096
#: Up to so many distinct memberships the steps run on the driver.
FEW_MEMBERSHIPS = 20_000

_WORD = re.compile(r"\w+")


@dataclass
class Classifier:
    weights: np.ndarray  # features + 1 x domains
    accuracy: float  # on held-out rows
    temperature: float


def featurise(texts: list[str], features: int = FEATURES) -> np.ndarray:
    """Hashed words and word pairs, square-rooted counts of unit length."""
    x = np.zeros((len(texts), features), np.float32)
    for i, text in enumerate(texts):
        words = _WORD.findall(text.lower())
        for w in [*words, *map(" ".join, zip(words, words[1:]))]:
            x[i, zlib.crc32(w.encode()) % features] += 1
    np.sqrt(x, out=x)
    return x / np.maximum(1e-6, np.linalg.norm(x, axis=1, keepdims=True))


def posterior(model: Classifier, x: np.ndarray) -> np.ndarray:
    z = (x @ model.weights[:-1] + model.weights[-1]) / model.temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, domains: int, rounds: int = 150, ridge: float = 1e-3) -> Classifier:
    """Softmax regression; every fifth row is held out for temperature and accuracy.

    A domain without any row gets a posterior of zero.
    """
    held = np.arange(len(x)) % 5 == 0
    if held.all() or not held.any():
        held = np.zeros(len(x), bool)
    a, b = x[~held], y[~held]
    hot = np.eye(domains, dtype=np.float32)[b]
    w = np.zeros((x.shape[1] + 1, domains), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = a @ w[:-1] + w[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = (z / z.sum(axis=1, keepdims=True) - hot) / max(1, len(a))
        g = np.vstack([a.T @ error + ridge * w[:-1], error.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w[-1, np.bincount(y, minlength=domains) == 0] = -np.inf
    model = Classifier(w, 0.0, 1.0)
    if held.any():
        best = None
        for temperature in (1.0, 1.5, 2.0, 3.0, 5.0, 8.0, 13.0, 30.0):
            model.temperature = temperature
            p = posterior(model, x[held])
            loss = -np.log(np.maximum(1e-9, p[np.arange(len(p)), y[held]])).mean()
            if best is None or loss < best[0]:
                best = (loss, temperature)
        model.temperature = best[1]
        model.accuracy = float((posterior(model, x[held]).argmax(axis=1) == y[held]).mean())
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = featurise(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["source", "features"])


MEMBERS = T.StructType([T.StructField("unit", T.LongType()), T.StructField("membership", T.ArrayType(T.DoubleType()))])


def _guess(weights: np.ndarray, temperature: float, sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(weights, 0.0, temperature)
        for batch in batches:
            if not batch.num_rows:
                continue
            p = posterior(model, featurise(batch.column(1).to_pylist())).astype(np.float64)
            p /= p.sum(axis=1, keepdims=True)
            keep = np.flatnonzero(p.max(axis=1) >= sure)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(p[keep].tolist(), pa.list_(pa.float64()))], names=MEMBERS.names)

    return run


def rates(membership: np.ndarray, caps: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps so far: each moved by the errors of its domains and put back into its bounds.

    A text may be drawn as often as its domains allow on average, but not more often than the likeliest does.
    """
    cap = np.minimum(membership @ caps, caps[membership.argmax(axis=1)])
    r = np.minimum(1.0, cap)
    for step in history:
        r = np.clip(r + membership @ step, 0.0, cap)
    return r


@dataclass
class Mix:
    drawn: DataFrame  # doc_id, source, domain (the likeliest), tokens, copies, membership (by domain, in order of their names)
    shares: DataFrame
    accuracy: float


DRAWN = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("copies", T.IntegerType()), T.StructField("membership", T.ArrayType(T.DoubleType()))]
)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, sure: float = 0.0, tokenizer: str = tokens.BYTE_BPE, folder: str = tokens.TOKENIZERS) -> Mix:
    """Copies of each text so that domain totals come as near to their shares as repeats allow.

    ``documents`` has ``doc_id, text, source``, ``targets`` has ``source,
    target_share, max_repeats`` (a small table, one row per domain; rows
    without a source or a share are left out).  Null and blank texts are never
    drawn.  A text that occurs several times counts once; if several domains
    hold it, the scarcest has it.  The default size is the largest at which
    every domain that has texts reaches its share, but at least ``LEAST_SIZE``
    of what there is; domains that then fall short give all they may.  Texts
    without a source take part if two domains at least have labelled texts;
    ``sure`` leaves out those whose highest posterior is below it.  ``shares``
    counts each drawn text by its membership.
    """
    spark = documents.sparkSession
    goals = sorted({r["source"]: r for r in targets.select("source", "target_share", "max_repeats").where("source is not null and target_share is not null").collect()}.values(), key=lambda r: r["source"])
    names = [r["source"] for r in goals]
    share = np.array([r["target_share"] for r in goals], float)
    caps = np.array([max(0, r["max_repeats"] if r["max_repeats"] is not None else 1) for r in goals], float)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source").where(~is_blank(F.col("text")))
    unnamed = is_blank(F.col("source"))
    known = F.col("source").isin(names) if names else F.lit(False)
    rows = texts.where(known | unnamed).withColumn("digest", F.md5("text"))
    # one row per text; a named domain goes before an unknown one, the scarcest first
    supply = {r["source"]: r["n"] for r in rows.where(known).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    scarcity = {n: supply[n] * caps[i] / max(1e-9, share[i]) for i, n in enumerate(names) if n in supply}
    rank = F.lit(len(names))
    for place, name in enumerate(sorted(scarcity, key=lambda n: (scarcity[n], n))):
        rank = F.when(F.col("source") == name, place).otherwise(rank)
    owners = rows.groupBy("digest").agg(F.min(F.struct(rank.alias("rank"), "doc_id", "source")).alias("o"), F.first("text").alias("text"))
    # texts have numbers of their own: an id may hold several texts, each of which counts
    owned = staged(owners.select(F.monotonically_increasing_id().alias("unit"), "o.doc_id", "o.source", "text"), "mix-owners")
    owners = owned.drop("text")
    counted = tokens.count_tokens(owned.select(F.col("unit").alias("doc_id"), "text"), tokenizer, folder).withColumnRenamed("doc_id", "unit")

    labelled = owned.where(F.col("source").isNotNull() & (F.trim("source") != ""))
    every = max(1, owners.count() // LABELLED_ROWS)
    picked = labelled.where(F.pmod(F.xxhash64("unit"), F.lit(every)) == 0).select("source", "text").limit(LABELLED_ROWS)
    # features are made where the texts are; the driver gets 4 KB a row, 34 MB at most
    fitted = picked.mapInArrow(_featured, "source string, features binary").toArrow()
    model, labels = None, fitted["source"].to_pylist()
    if len(set(labels)) > 1:
        x = np.frombuffer(b"".join(fitted["features"].to_pylist()), np.float32).reshape(-1, FEATURES)
        model = train(x, np.array([names.index(n) for n in labels]), len(names))

    named = F.array(*[F.when(F.col("source") == x, 1.0).otherwise(0.0) for x in names]) if names else F.array().cast("array<double>")
    members = owners.where(~unnamed).select("unit", named.alias("membership"))
    if model is not None:
        open_ = owned.where(unnamed).select("unit", "text")
        members = members.unionByName(open_.mapInArrow(_guess(model.weights, model.temperature, sure), MEMBERS))
    units = staged(members.join(counted, "unit").join(owners, "unit").where("tokens > 0"), "mix-units")

    totals = _totals(units, caps, names)
    have = totals([], np.ones(len(names)))  # tokens by domain, each text once
    able = totals([np.full(len(names), caps.max(initial=0.0))], None)  # all rates at their bounds
    filled = (share > 0) & (able > 0)
    least, given = LEAST_SIZE * have.sum(), total_tokens is not None
    if not given:
        total_tokens = max((able[filled] / share[filled]).min() if filled.any() else 0.0, least)
    goal = share * total_tokens
    history = _fit(totals, goal, have)
    # where most texts are of several domains, these can't all reach what each could alone
    while not given and total_tokens > least and (np.abs(goal - totals(history, None)) > SLACK * goal)[filled].any():
        total_tokens = max(least, 0.9 * total_tokens)
        goal = share * total_tokens
        history = _fit(totals, goal, have)
    drawn = _draw(units, caps, names, history, np.minimum(goal, able))
    drawn = staged(drawn, "mix-drawn")
    reached = drawn.groupBy("domain").agg(F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    wanted = spark.createDataFrame([(i, a, float(b), int(c)) for i, (a, b, c) in enumerate(zip(names, share, caps))], "place int, source string, target_share double, max_repeats int")
    held = wanted.join(_held(drawn, "copies"), "place", "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    # whole tokens that add up to all drawn ones: the largest fractions are rounded up
    whole = held.withColumn("drawn_tokens", F.floor("held")).withColumn("fraction", F.col("held") - F.col("drawn_tokens"))
    left = F.round(F.sum("held").over(_all())).cast("long") - F.sum("drawn_tokens").over(_all())
    order = F.row_number().over(_all().orderBy(F.desc("fraction"), "place"))
    counted = whole.withColumn("left", left).withColumn("order", order).withColumn("drawn_tokens", F.col("drawn_tokens") + (F.col("order") <= F.col("left")).cast("long"))
    everything = F.greatest(F.lit(1), F.sum("drawn_tokens").over(_all()))
    shares = counted.join(reached, F.col("source") == F.col("domain"), "left").select(
        "source", "target_share", "max_repeats", (F.col("drawn_tokens") / everything).alias("reached_share"), "drawn_tokens",
        F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return Mix(drawn, shares, model.accuracy if model else 0.0)


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(0))  # over the targets, a row per domain


def _fit(totals, goal: np.ndarray, have: np.ndarray) -> list[np.ndarray]:
    """The steps that bring the expected totals to the goals."""
    history: list[np.ndarray] = []
    for _ in range(STEPS):
        error = goal - totals(history, None)
        open_to = (np.abs(error) > 1e-4 * np.maximum(1.0, goal)) & (have > 0)
        # what no domain can still give or take doesn't move
        if not open_to.any() or (len(history) > 1 and np.allclose(error, last, rtol=0, atol=1e-6 * max(1.0, goal.sum()))):
            break
        last = error
        history.append(np.where(have > 0, error / np.maximum(1.0, have), 0.0))
    return history


def _held(rows: DataFrame, times: str) -> DataFrame:
    """``place, held``: the tokens of each domain, by its place, where each text counts ``times`` over."""
    return rows.select(F.posexplode("membership").alias("place", "part"), (F.col("tokens") * F.col(times)).alias("n")).where("part > 0").groupBy("place").agg(F.sum(F.col("part") * F.col("n")).alias("held"))


def _totals(units: DataFrame, caps: np.ndarray, names: list[str]):
    """Expected tokens of each domain at the rates of a history."""
    k = len(names)
    if not k:
        return lambda history, fixed: np.zeros(0)
    grouped = staged(units.groupBy("membership").agg(F.sum("tokens").alias("tokens")), "mix-memberships")
    few = grouped.limit(FEW_MEMBERSHIPS + 1).toArrow()
    if few.num_rows <= FEW_MEMBERSHIPS:
        held = few["membership"].combine_chunks().flatten().to_numpy().reshape(-1, k) if few.num_rows else np.zeros((0, k))
        weights = few["tokens"].to_numpy().astype(float)
        return lambda history, fixed: (weights * (1.0 if fixed is not None else rates(held, caps, history))) @ held
    schema = T.StructType([T.StructField(f"t{i}", T.DoubleType()) for i in range(k)])
    columns = schema.names

    def of(history: list[np.ndarray], fixed: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for batch in batches:
                p = batch.column(0).flatten().to_numpy().reshape(-1, k)
                weight = batch.column(1).to_numpy().astype(float)
                total += (weight * (1.0 if fixed is not None else rates(p, caps, history))) @ p
            yield pa.RecordBatch.from_arrays([pa.array([t]) for t in total], names=columns)

        row = grouped.select("membership", "tokens").mapInArrow(run, schema).agg(*[F.sum(c).alias(c) for c in schema.names]).first()
        return np.array([x or 0.0 for x in row])

    return of


def _draw(units: DataFrame, caps: np.ndarray, names: list[str], history: list[np.ndarray], goal: np.ndarray) -> DataFrame:
    """Whole copies: the rate plus a hash of the document, cut down, with a shift per domain.

    The shift comes from a histogram of tokens over the fractions, at most
    ``BUCKETS`` rows per domain.  It moves the texts that belong to one domain
    wholly; those of several would move the others too.
    """
    k = len(names)
    if not k:
        return units.sparkSession.createDataFrame([], DRAWN)
    expected = T.StructType([*units.schema.fields, T.StructField("domain", T.IntegerType()), T.StructField("level", T.DoubleType()), T.StructField("cap", T.IntegerType()), T.StructField("whole", T.BooleanType())])

    kept = [f.name for f in units.schema.fields]
    columns = expected.names

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("membership").flatten().to_numpy().reshape(-1, k)
            u = batch.column("u").to_numpy()
            domain = p.argmax(axis=1)
            cap = caps[domain].astype(np.int32)
            cols = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(domain.astype(np.int32)), pa.array(rates(p, caps, history) + u), pa.array(cap), pa.array(p.max(axis=1) == 1.0)], names=columns)

    u = F.pmod(F.xxhash64(F.lit("draw"), "unit"), F.lit(1 << 30)) / float(1 << 30)
    leveled = staged(units.withColumn("u", u).mapInArrow(level, expected), "mix-levels")
    fraction = F.col("level") - F.floor("level")
    base = F.least(F.floor("level").cast("int"), F.col("cap"))
    bucket = F.least(F.floor(fraction * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    rows = leveled.withColumn("bucket", bucket).withColumn("base", base)
    shared = {r["place"]: r["held"] for r in _held(rows.where("not whole"), "base").collect()}
    up = F.sum(F.when(F.col("base") < F.col("cap"), F.col("tokens")).otherwise(0)).alias("up")
    down = F.sum(F.when(F.col("base") > 0, F.col("tokens")).otherwise(0)).alias("down")
    histogram = rows.where("whole").groupBy("domain", "bucket").agg(up, down, F.sum(F.col("tokens") * F.col("base")).alias("now")).collect()
    shift_up, shift_down = [BUCKETS] * k, [0] * k
    for d in range(k):
        mine = sorted((r for r in histogram if r["domain"] == d), key=lambda r: r["bucket"])
        missing = goal[d] - shared.get(d, 0.0) - sum(r["now"] for r in mine)
        if missing > 0:
            for r in reversed(mine):
                if r["up"] > 2 * missing:
                    break
                missing -= r["up"]
                shift_up[d] = r["bucket"]
        else:
            for r in mine:
                if r["down"] > -2 * missing:
                    break
                missing += r["down"]
                shift_down[d] = r["bucket"] + 1
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("domain") + 1)
    copies = F.when(~F.col("whole"), F.col("base")).when((F.col("bucket") >= pick(shift_up)) & (F.col("base") < F.col("cap")), F.col("base") + 1).when((F.col("bucket") < pick(shift_down)) & (F.col("base") > 0), F.col("base") - 1).otherwise(F.col("base"))
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("domain") + 1)
    return rows.select("doc_id", "source", name.alias("domain"), "tokens", copies.cast("int").alias("copies"), "membership").where("copies > 0")
