"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to 4 with frozen counts. A byte
costs -log2 of its probability in the longest context that was seen; where the
context was seen but never followed by that byte, an escape is paid (method C:
escape with q/(n+q) for q distinct successors among n) and the next shorter
context is tried, down to a uniform byte. With frozen counts the cost depends on
five bytes only, so costs are looked up for whole arrays of text positions.

The trees are fitted on a bounded sample: at most ``SAMPLE_BYTES`` of distinct text of
each language, cut into parts of ``PART`` bytes that each follow the bytes before
them, and taken in the order of a hash. A part is never longer than the bound, so every
language with a byte of labelled text is fitted, and one within the bound is fitted
on all of it. All contexts of the sample are kept. Every whole text is scored.

A null text and one without a letter are ``und`` with score 0. The score is the
weight of the best language when each weighs 2 to the minus bits per byte. Equal
costs go to the first language by name. With no labelled text all are ``und``.
Null languages are not learned from; a part counts as often as it occurs, and once
for the bound;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.session import durable

ORDER = 4
SAMPLE_BYTES = 1 << 21
PART = 1 << 16
PIECE = 1 << 21
SLOTS = 20
EDGE = b"\n" * ORDER
_MASK = np.uint64((1 << 8 * (ORDER + 1)) - 1)


def gram_keys(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, begin, end): five-byte keys of a buffer, oldest byte lowest, and the range of each piece's own keys.

    A piece starts with the ORDER bytes before it.
    """
    buffer = b"".join(pieces) + bytes(8)
    keys = np.ndarray((len(buffer) - 8,), "<u8", buffer, strides=(1,)) & _MASK
    ends = np.cumsum([len(p) for p in pieces])
    begins = np.append(0, ends[:-1])
    return keys, begins, ends - ORDER


def pieces_of(raw: bytes):
    """Parts of a text, each after the bytes that precede it."""
    raw = EDGE + raw
    for at in range(0, max(1, len(raw) - ORDER), PIECE):
        yield raw[at : at + PIECE + ORDER]


class Trees:
    """Costs of bytes after their contexts, for every language at once."""

    def __init__(self, languages: list[str], which: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.languages = languages
        self.levels = []
        for lang in range(len(languages)):
            own, n = keys[which == lang].astype(np.uint64), counts[which == lang]
            levels = []
            for order in range(ORDER + 1):
                grams, place = np.unique(own >> np.uint64(8 * (ORDER - order)), return_inverse=True)
                seen = np.bincount(place, n, len(grams))
                contexts, of = np.unique(grams & np.uint64((1 << 8 * order) - 1), return_inverse=True)
                total, kinds = np.bincount(of, seen, len(contexts)), np.bincount(of, minlength=len(contexts))
                levels.append((grams, -np.log2(seen / (total + kinds)[of]), contexts, -np.log2(kinds / (total + kinds))))
            self.levels.append(levels)
        self.slot_keys = np.full(1 << SLOTS, 1 << 63, np.uint64)
        self.slot_costs = np.zeros((1 << SLOTS, len(languages)), np.float32)

    def price(self, keys: np.ndarray) -> np.ndarray:
        """Cost in bits of each key's last byte, one column per language."""
        out = np.empty((len(keys), len(self.languages)), np.float32)
        for lang, levels in enumerate(self.levels):
            cost = np.full(len(keys), 8.0)
            for order, (grams, bits, contexts, escape) in enumerate(levels):
                if not len(grams):
                    continue
                part = keys >> np.uint64(8 * (ORDER - order))
                at = np.minimum(np.searchsorted(grams, part), len(grams) - 1)
                context = part & np.uint64((1 << 8 * order) - 1)
                above = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                known = contexts[above] == context
                cost = np.where(grams[at] == part, bits[at], cost + np.where(known, escape[above], 0.0))
            out[:, lang] = cost
        return out

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """As ``price``, through a table of the keys met so far."""
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        missed = np.flatnonzero(self.slot_keys[slot] != keys)
        out = self.slot_costs[slot]
        if len(missed):
            fresh, back = np.unique(keys[missed], return_inverse=True)
            priced = self.price(fresh)
            out[missed] = priced[back]
            where = ((fresh * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
            free = self.slot_keys[where] == np.uint64(1 << 63)
            where, first = np.unique(where[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.slot_keys[where], self.slot_costs[where] = fresh[chosen], priced[chosen]
        return out


def count_grams(batches):
    for batch in batches:
        gathered: dict[str, list] = {}
        for lang, raw, n in zip(batch["lang"].to_pylist(), batch["part"], batch["n"].to_pylist()):
            keys, begins, ends = gram_keys([raw.as_py()])
            own = gathered.setdefault(lang, [])
            own.append((keys[: ends[0]], n))
            if sum(len(k) for k, _ in own) > PIECE:
                yield _counted(lang, gathered.pop(lang))
        for lang, own in gathered.items():
            yield _counted(lang, own)


def _counted(lang: str, own: list) -> pa.RecordBatch:
    grams, of = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
    n = np.zeros(len(grams), np.int64)
    np.add.at(n, of, np.repeat([n for _, n in own], [len(k) for k, _ in own]))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def sample(labelled: DataFrame) -> DataFrame:
    """(lang, part, n): distinct parts of each language in hash order up to SAMPLE_BYTES, with how often they occur.

    Bytes are added up over 1,024 ranges of the hash and then within the ranges that
    begin below the bound; only parts in ranges that are drawn from are sent.
    """
    raw = labelled.select("lang", F.concat(F.lit(EDGE), F.encode("text", "UTF-8")).alias("raw"))
    starts = raw.where(F.octet_length("raw") > ORDER).select("lang", "raw", F.explode(F.sequence(F.lit(1), F.octet_length("raw") - ORDER, F.lit(PART))).alias("at"))
    parts = starts.select("lang", F.substring("raw", F.col("at"), F.lit(PART + ORDER)).alias("part"))
    key = ["lang", "a", "b"]
    hashed = parts.select("lang", F.xxhash64("part").alias("a"), F.xxhash64(F.lit(7), "part").alias("b"), "part")
    sizes = durable(hashed.groupBy(*key).agg(F.max(F.octet_length("part") - ORDER).alias("bytes"), F.count("*").alias("n")).withColumn("bin", F.shiftrightunsigned("a", 54)))
    before = F.sum("held").over(Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = sizes.groupBy("lang", "bin").agg(F.sum("bytes").alias("held")).select("lang", "bin", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < SAMPLE_BYTES)
    upto = F.col("before") + F.sum("bytes").over(Window.partitionBy("lang", "bin").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0))
    drawn = durable(sizes.join(bins, ["lang", "bin"]).withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select(*key, "bin", "n"))
    last = drawn.groupBy("lang").agg(F.max("bin").alias("last"))
    near = hashed.join(F.broadcast(last), "lang").where(F.shiftrightunsigned("a", 54) <= F.col("last"))
    return near.groupBy(*key).agg(F.first("part").alias("part")).join(drawn, key).select("lang", "part", "n")


def fit(labelled: DataFrame) -> Trees:
    """Trees from (text, lang) rows; sample and counting run in Spark, the bounded tables go to the driver."""
    counted = sample(labelled).mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    named = table["lang"].combine_chunks().dictionary_encode()
    found = named.dictionary.to_pylist()
    languages = sorted(found)
    which = np.array([languages.index(x) for x in found], np.int64)[named.indices.to_numpy()] if found else np.empty(0, np.int64)
    return Trees(languages, which, table["gram"].to_numpy(), table["n"].to_numpy())


PREDICTED = "id long, held_out boolean, lang_pred string, score double"


def predict(shared):
    names = [x.split()[0] for x in PREDICTED.split(", ")]

    def run(batches):
        trees = shared.value
        for batch in batches:
            texts = batch["text"]
            best, score = ["und"] * len(texts), [0.0] * len(texts)
            held, size, totals, lengths = [], 0, {}, {}

            def flush():
                keys, begins, ends = gram_keys([p for _, p in held])
                edges = np.column_stack((begins, ends)).ravel()
                sums = np.add.reduceat(trees.costs(keys), edges, axis=0, dtype=np.float64)[::2]
                for (k, part), bits in zip(held, sums):
                    totals[k] = totals.get(k, 0) + bits
                    lengths[k] = lengths.get(k, 0) + len(part) - ORDER

            for k, text in enumerate(texts):
                text = text.as_py()
                if text is None or not trees.languages or not any(map(str.isalpha, text)):
                    continue
                for part in pieces_of(text.encode()):
                    held.append((k, part))
                    size += len(part)
                    if size > PIECE:
                        flush()
                        held, size = [], 0
            if held:
                flush()
            for k, bits in totals.items():
                weights = np.exp2((bits.min() - bits) / lengths[k])
                best[k], score[k] = trees.languages[int(bits.argmin())], float(weights.max() / weights.sum())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array(best), pa.array(score)], names)

    return run


def held_out(id_column: str) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): fit on labelled rows that are not held out, predict all."""
    text = F.col(text_column).cast("string")
    learn = docs.where(F.col(id_column).isNotNull() & ~held_out(id_column) & F.col(lang_column).isNotNull() & text.isNotNull())
    trees = fit(learn.select(text.alias("text"), F.col(lang_column).cast("string").alias("lang")))
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), held_out(id_column).alias("held_out"), text.alias("text"))
    return rows.mapInArrow(predict(shared), PREDICTED)
