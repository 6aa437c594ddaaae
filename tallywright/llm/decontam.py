"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units of measure and names (capitalised words inside a sentence) are typed placeholders, other
words stand lower-cased without the punctuation around them. A capitalised word that opens a sentence may be a name or not, unless it is
one of ``COMMON``: windows that hold one have both readings, and match where either does. Items and documents are cut into windows of
five tokens. A window with fewer than two plain words keeps its values, so that templates made of placeholders alone match only themselves.

Items of the same template whose equal values stand in the same slots form a class. A document's windows are looked up among the classes'
windows: first those of each class's rarest windows (any document that holds 0.8 of a class's windows holds one of them), then, for the
documents and classes found so, all. On each alignment of document and item, an item's value must stand for one document value
throughout (slot consistency); windows that break this do not count. A document is contaminated when consistent windows cover at least
0.8 of the class's.

Defined results: null and empty texts and items hold no window; an item shorter than a window is one short window that keeps its
values, looked for at every place of a document; repeated items fall into one class; repeated document rows are judged together by their id and text. Empty tables give no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import kept, materialize, narrow, text_or_empty

SIZE, COVER, PLAIN = 5, 0.8, 2
MOST_LOOKED_UP = 2_000_000  # window hashes sent to every task; beyond it a bitmap of them is sent
BITS, PROBES = 1 << 27, 2  # of that bitmap: 16 MB at most
MOST_UNITS = 250_000
# fixed values: units of measure
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ton tons ml cl l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent % $ € £ kb mb gb tb hz khz mhz ghz w kw v a °c °f c f mph kmh".split())
# words that open sentences without being names
COMMON = frozenset("a an the this that these those there here it its he she they we i you his her their our my your who whom whose what which when where why how if in on at of for from to by with without about after before during between into over under and or but so then than as while because since until although though however each every all both some any no not one two three four five many much more most another other once find calculate compute determine solve give given let suppose assume show is are was were do does did can could will would should has have had el la los las un una qué cuál cuáles cuánto cuánta cuántos cuántas cómo cuándo dónde quién si en de del y o pero por para con der die das ein eine wer was wann wo wie warum welche welcher welches wenn und oder aber für mit von zu le les des une qui que quel quelle quels quelles quand où comment pourquoi combien et ou mais dans".split())
NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?$")
EDGES = ".,;:!?\"'()[]{}<>«»“”„‘’…*_`~"
WORD, NUM, UNIT = 0, 1, 2
_U = np.uint64
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SIZE)], _U)


class Reader:
    """Turns texts into template windows; what a unit of text stands for is remembered."""

    def __init__(self) -> None:
        self.marks = {k: self._hash(f"\0{k}") for k in ("number", "unit", "name")}
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.value: list[str] = []
        n = 1 << 14
        self.plain = np.zeros(n, _U)  # hash of the word itself
        self.template = np.zeros(n, _U)  # of its placeholder, if it is a number or unit
        self.kind, self.capital, self.ends, self.common = np.zeros(n, np.int8), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)

    @staticmethod
    def _hash(word: str) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 9)

    def _learn(self, unit: str) -> int:
        core = unit.strip(EDGES)
        if not core:
            self.known[unit] = -1
            return -1
        k = self.known[unit] = len(self.value)
        if k >= len(self.plain):
            for name in ("plain", "template", "kind", "capital", "ends", "common"):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, np.zeros_like(a)]))
        low = core.lower()
        kind = NUM if NUMBER.match(core) else UNIT if low in UNITS else WORD
        self.plain[k] = self.template[k] = self._hash(low)
        if kind != WORD:
            self.template[k] = self.marks["number" if kind == NUM else "unit"]
        self.kind[k], self.capital[k], self.common[k] = kind, core[0].isupper(), low in COMMON
        self.ends[k] = unit.rstrip("\"')]»”’").endswith((".", "!", "?", ":"))
        self.value.append(low)
        return k

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template hash, plain hash, is placeholder, may be a name besides, number of the unit) for each token."""
        if len(self.value) > MOST_UNITS:
            self._reset()
        known, learn, units = self.known, self._learn, text.split()
        rows = np.array([k if (k := known.get(u)) is not None else learn(u) for u in units], np.int64)
        rows = rows[rows >= 0]
        kind, ends = self.kind[rows], self.ends[rows]
        first = np.concatenate([[True], ends[:-1]]) if len(rows) else np.zeros(0, bool)
        capital = self.capital[rows] & (kind == WORD)
        name, opens = capital & ~first, capital & first & ~self.common[rows]
        template = self.template[rows]
        template[name] = self.marks["name"]
        return template, self.plain[rows], name | (kind != WORD), opens, rows

    def windows(self, text: str, shorter: Iterable[int] | None) -> tuple[list[tuple[np.ndarray, np.ndarray, int, np.ndarray]], np.ndarray]:
        """((positions, hash of each window, its size, placeholder flags of each token) for each reading, units). Short windows, over
        their values, are of the sizes ``shorter``, each at its first place; where that is None a short text is one short window."""
        template, plain, slot, opens, rows = self.tokens(text)
        n, out = len(rows), []
        none = np.zeros(n, bool)
        with np.errstate(over="ignore"):
            for size in ((n,) if 0 < n < SIZE else ()) if shorter is None else shorter:
                if size <= n:
                    m = n - size + 1
                    hashes, at = np.unique(sum(plain[k : k + m] * _POWERS[k] for k in range(size)) ^ _U(size), return_index=True)
                    out.append((at, hashes, size, none))
            if n < SIZE:
                return out, rows
            m = n - SIZE + 1
            b, held = np.zeros(m, _U), np.zeros(m, np.int64)
            for k in range(SIZE):
                b += plain[k : k + m] * _POWERS[k]
                held += opens[k : k + m]
            named = np.where(opens, _U(self.marks["name"]), template)
            for words, flags, at in ((template, slot, np.arange(m)), (named, slot | opens, np.flatnonzero(held))):
                if len(at):
                    a, fixed = np.zeros(m, _U), np.zeros(m, np.int64)
                    for k in range(SIZE):
                        a += words[k : k + m] * _POWERS[k]
                        fixed += ~flags[k : k + m]
                    out.append((at, np.where(fixed >= PLAIN, a, b)[at], SIZE, flags))
        return out, rows


def _rows_of(reader: Reader, text: str, wanted: Listed | Bitmap | None, shorter: Iterable[int] | None) -> list[tuple[int, int, list[str], int]]:
    """(position, window hash, values of its placeholders as "place:value", size)."""
    readings, rows = reader.windows(text, shorter)
    value, out = reader.value, []
    for place, hashes, size, slot in readings:
        hits = np.arange(len(hashes)) if wanted is None else np.flatnonzero(wanted.holds(hashes))
        signed = hashes.view(np.int64)
        out += [(p, int(signed[h]), [f"{k}:{value[rows[p + k]]}" for k in range(size) if slot[p + k]], size) for h in hits for p in [int(place[h])]]
    return out


class Listed:
    """Hashes looked for, all of them, ascending."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes


class Bitmap:
    """A Bloom filter of hashes looked for: finds each of them, and some others, which the joins after it drop."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for k in range(PROBES):
            bit = (hashes >> _U(27 * k)) & _U(BITS - 1)
            found &= (self.words[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1
        return found


def looked_up(windows: DataFrame) -> Listed | Bitmap:
    """What tells tasks which windows matter: the list of distinct ``window`` hashes, or beyond MOST_LOOKED_UP their bitmap, whose words
    (a row each, BITS / 64 at most) are put together by tasks."""
    if windows.count() <= MOST_LOOKED_UP:
        return Listed(np.sort(windows.toPandas()["window"].to_numpy(np.int64).view(_U)))
    bits = F.explode(F.array(*[F.shiftrightunsigned("window", 27 * k).bitwiseAND(BITS - 1) for k in range(PROBES)])).alias("bit")
    word, mask = F.shiftright("bit", 6), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")
    found = windows.select(bits).groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask")).toPandas()
    words = np.zeros(BITS // 64, _U)
    words[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(_U)
    return Bitmap(words)


def _windows(df: DataFrame, keys: list[str], wanted: Listed | Bitmap | None, shorter: list[int] | None) -> DataFrame:
    """keys, pos, window, slots, size of the windows of each row's text (last column)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, wanted = kept("templates", Reader), shared.value
        for b in narrow(batches):
            take, pos, window, slots, sizes = [], [], [], [], []
            for k, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for p, h, s, z in _rows_of(reader, text, wanted, shorter):
                    take.append(k)
                    pos.append(p)
                    window.append(h)
                    slots.append(s)
                    sizes.append(z)
            base = b.select(keys).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*base.columns, pa.array(pos, pa.int64()), pa.array(window, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(sizes, pa.int64())], names=[*keys, "pos", "window", "slots", "size"])

    return df.select(*keys, df.columns[-1]).mapInArrow(run, f"{kinds}, pos long, window long, slots array<string>, size long")


def _value(slot: Column) -> Column:
    """What stands in a slot, without its place in the window."""
    return F.regexp_extract(slot, "^\\d+:(.*)$", 1)


def benchmark_classes(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows of each class: class, pos, window, slots, size; members: class, item_id, n_windows, n_items, n_variants; values of each
    different member where a class has several: class, variant, item_at, window, slots). Items of a class have the same windows and the
    same slots with equal values, so that what is consistent with one of them is with all: the class's windows are those of any one."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.xxhash64(F.col(text_col)).alias("th"), text_or_empty(text_col).alias("__text"))
    raw = _windows(rows.dropDuplicates(["th"]).select("th", "__text"), ["th"], None, None)
    # where both readings of a window are one, that with more placeholders
    one = raw.groupBy("th", "pos", "window").agg(F.max(F.struct(F.size("slots").alias("n"), "slots", "size")).alias("most")).select("th", "pos", "window", "most.slots", "most.size")
    one = materialize(one, "items")
    shape = one.groupBy("th").agg(F.array_sort(F.collect_list(F.struct("pos", "window", "slots"))).alias("all"), F.max("pos").alias("last"))
    shape = shape.withColumn("values", F.flatten(F.transform("all", lambda x: F.transform(x["slots"], _value)))).withColumn("known", F.array_distinct("values"))
    equal = F.transform("values", lambda v: F.array_position(F.col("known"), v))
    shape = shape.select("th", "last", F.xxhash64(F.transform("all", lambda x: F.struct(x["pos"], x["window"])), equal).alias("class"), F.xxhash64("all").alias("variant"))
    shape = materialize(shape, "shapes")
    named = rows.select("item_id", "th").distinct().join(shape, "th")
    members = named.groupBy("class").agg(F.min("item_id").alias("item_id"), (F.max("last") + 1).alias("n_windows"), F.count(F.lit(1)).alias("n_items"), F.count_distinct("variant").alias("n_variants"))
    windows = one.join(shape.groupBy("class").agg(F.min("th").alias("th")), "th").select("class", "pos", "window", "slots", "size")
    several = members.where(F.col("n_variants") > 1).select("class")
    variants = one.join(shape.groupBy("class", "variant").agg(F.min("th").alias("th")).join(several, "class"), "th")
    return windows, members, variants.select("class", "variant", F.col("pos").alias("item_at"), "window", "slots")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """A row per document (id and text hash) and template class it holds: doc_id, text_hash, item_id (smallest of the class), n_items,
    n_windows, n_matched, coverage, kind (``exact`` where all values equal those of one of the class's items, else ``reparameterised``)."""
    windows, members, variants = benchmark_classes(items, text_col=text_col)
    windows, members = materialize(windows, "windows"), materialize(members, "members")
    distinct = materialize(windows.select("window").distinct(), "distinct")
    wanted = looked_up(distinct)
    shorter = sorted(r[0] for r in windows.where(F.col("size") < SIZE).select("size").distinct().collect())
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), text_or_empty(text_col).alias("__text"))
    hits = materialize(_windows(slim, ["doc_id", "text_hash"], wanted, shorter), "hits")
    # seeds: of each class, the places whose windows are rarest among classes, one more than may be missing
    rare = windows.groupBy("window").agg(F.count_distinct("class").alias("spread"))
    order = Window.partitionBy("class").orderBy("spread", "least", "pos")
    places = windows.join(rare, "window").groupBy("class", "pos").agg(F.sum("spread").alias("spread"), F.min("window").alias("least"), F.collect_set("window").alias("all"))
    seeds = places.join(members.select("class", "n_windows"), "class").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n_windows") - F.ceil(cover * F.col("n_windows") - 1e-9) + 1)
    pairs = hits.select("doc_id", "text_hash", "window").join(seeds.select("class", F.explode("all").alias("window")).distinct(), "window").select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "class").distinct()
    both = hits.join(pairs, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash"))).select("doc_id", "text_hash", "class", F.col("pos").alias("at"), F.col("window"), F.col("slots").alias("doc_slots"))
    met = both.join(windows.select("class", "window", F.col("pos").alias("item_at"), F.col("slots").alias("item_slots")), ["class", "window"]).withColumn("shift", F.col("at") - F.col("item_at"))
    # where both readings of a window match, that with more placeholders tells what the words stand for
    met = met.groupBy("doc_id", "text_hash", "class", "shift", "item_at").agg(F.max(F.struct(F.size("item_slots").alias("n"), "item_slots", "doc_slots", "window")).alias("most")).select("doc_id", "text_hash", "class", "shift", "item_at", "most.item_slots", "most.doc_slots", "most.window")
    # slot consistency on each alignment: one document value for each item value
    where = ["doc_id", "text_hash", "class", "shift"]
    slot = met.select(*where, F.explode(F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))).alias("s"))
    broken = slot.select(*where, _value(F.col("s.i")).alias("i"), _value(F.col("s.d")).alias("d")).groupBy(*where, "i").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).where(F.col("d0") != F.col("d1")).groupBy(*where).agg(F.collect_set("i").alias("bad"))
    judged = met.join(broken.select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash"), F.col("class").alias("b_class"), F.col("shift").alias("b_shift"), "bad"), F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash")) & (F.col("class") == F.col("b_class")) & (F.col("shift") == F.col("b_shift")), "left")
    consistent = judged.where(F.col("bad").isNull() | ~F.arrays_overlap(F.transform("item_slots", _value), F.col("bad")))
    told = F.filter(F.collect_set(F.struct("item_at", "window", F.col("doc_slots").alias("slots"))), lambda x: F.size(x["slots"]) > 0)
    found = consistent.groupBy("doc_id", "text_hash", "class").agg(F.count_distinct("item_at").alias("n_matched"), F.bool_and(F.col("item_slots") == F.col("doc_slots")).alias("same"), told.alias("told"))
    out = found.join(members, "class").withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= cover)
    out = materialize(out.withColumn("told", F.when(~F.col("same") & (F.col("n_variants") > 1), F.col("told"))).withColumn("k", F.monotonically_increasing_id()), "found")
    # the values of another item of the class
    open_ones = out.select("k", "class", F.size("told").alias("n"), F.explode("told").alias("x")).select("k", "class", "n", "x.*")
    agree = open_ones.join(variants, ["class", "item_at", "window", "slots"]).groupBy("k", "variant").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    other = agree.where(F.col("m") == F.col("n")).select("k", F.lit(True).alias("others")).distinct()
    kind = F.when(F.col("same") | F.coalesce("others", F.lit(False)), "exact").otherwise("reparameterised")
    return out.join(other, "k", "left").select("doc_id", "text_hash", "item_id", "n_items", "n_windows", "n_matched", "coverage", kind.alias("kind"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is contaminated; columns and repeated clean rows stay as they are."""
    bad = materialize(contaminated(docs, items, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "bad")
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__hash")), "left_anti")
