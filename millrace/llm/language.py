"""Problem 7: the language of texts and of the passages of mixed ones, by Bayesian evidence fusion.

Text likelihoods of hashed character n-grams and words (trained on labelled samples) are fused, sentence by sentence,
with the declared language, an address suffix where there is one, and a prior of the record's host (source). Priors come
from one grouped aggregation of the declared labels and are smoothed hierarchically: a host's counts towards the
corpus', the corpus' towards uniform. A hidden-Markov pass over the sentences of a text makes a change of language cost
something, so that names, headings and single foreign words make no segment; runs of one language are the segments, each
with the posterior of its language as confidence.

The languages are those of the samples, whatever they are; codes that NOTATIONS does not know are understood as they stand.
Null, blank and bare placeholder values, and texts without letters, have no segment. Labels in any notation (codes of
two or three letters, English or own names, with regions) are understood; all else names no language.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import codepoints as cp
from millrace.llm.sentences import sentence_offsets
from millrace.llm.visual_form import plain
from millrace.session import broadcast_if_small, cut

CODES = ("en", "es", "fr", "de", "it", "pt", "ru", "ar", "zh")
#: Notations of the languages (ISO 639-1/2/3 codes, English and own names).
NOTATIONS = """
en eng english anglais englisch inglés inglese
es spa spanish español espanol castellano esp castilian
fr fra fre french français francais
de deu ger german deutsch
it ita italian italiano
pt por portuguese português portugues
ru rus russian русский
ar ara arb arabic العربية عربي
zh zho chi cmn chinese mandarin 中文 汉语 漢語
"""
PLACEHOLDERS = ("n/a", "na", "null", "none", "nil", "nan", "undefined", "-", "--", "—", "<empty>", "[]", "{}", "()", "empty", "[empty]", "(empty)", "tbd", "todo", "...", "…", "?", "<null>", "<none>", "no response", "[no response]", "no answer")
#: Country suffixes of addresses and locales, by the language most used there.
SUFFIXES = """
en uk gb us au nz ie ca za
es es mx ar co cl pe ve
fr fr be lu sn
de de at ch li
it it sm
pt pt br ao mz
ru ru by kz
ar eg sa ae iq ma dz jo
zh cn tw hk sg
"""
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
ERROR = 0.08  # share of declared labels taken to be wrong
SUFFIX_ERROR = 0.4  # the same of suffixes
TEMPER = 0.35  # neighbouring n-grams are not independent
SWITCH = 0.004
MAX_SAMPLES = 20_000
LONG = 20_000


def declared_code(label: Column, codes: tuple[str, ...] = CODES) -> Column:
    """The code a label names, or null: its first part that is a notation of a language, or one of ``codes``."""
    names = {name: row.split()[0] for row in NOTATIONS.strip().split("\n") for name in row.split()}
    names |= {c.lower(): c for c in codes}
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    parts = F.split(F.lower(label), r"[^\p{L}\p{M}]+")
    return F.try_element_at(F.filter(F.transform(parts, lambda p: F.try_element_at(known, p)), lambda c: c.isNotNull()), F.lit(1))


def suffix_code(address: Column) -> Column:
    """The code that the country suffix of an address (host.de, https://host.de/x) or locale (de-AT) hints at, or null."""
    pairs = [F.lit(x) for row in SUFFIXES.strip().split("\n") for name in row.split()[1:] for x in (name, row.split()[0])]
    host = F.regexp_replace(F.lower(address), r"^[a-z]+://|[/:?#].*$", "")
    return F.try_element_at(F.create_map(*pairs), F.regexp_extract(host, r"[._-]([a-z]{2})(?:\.utf-?8)?$", 1))


def is_placeholder(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")).isin(*PLACEHOLDERS)


def bounded_sample(df: DataFrame, n: int, key: list[str], cols: list[str], usable: Column, texts: list[str], n_rows: int | None = None) -> list:
    """At most ``n`` usable rows to train on, by the hash of their key; rows whose ``texts`` exceed LONG bytes only where
    there are not enough others.

    The share read is set by the number of rows (``n_rows`` where it is known), so that about 2 n of them reach the final sort whatever the size.
    """
    every = max(1, (df.count() if n_rows is None else n_rows) // (2 * n))
    size = sum((F.octet_length(t) for t in texts), F.lit(0))
    some = df.withColumn("_h", F.xxhash64(*key)).where((F.pmod(F.col("_h"), F.lit(every)) == 0) & usable)
    return some.withColumn("_long", size > LONG).orderBy("_long", "_h", *key).limit(n).select(*cols).collect()


class Model:
    """Log likelihoods of hashed features under each language."""

    def __init__(self, codes: tuple[str, ...], tables: list[np.ndarray], orders: tuple[int, ...]):
        self.codes, self.tables, self.orders = codes, tables, orders

    @staticmethod
    def features(cps: np.ndarray, offs: np.ndarray, orders: tuple[int, ...]) -> list[cp.Flat]:
        """Hashed features of plain texts: n-grams of each order, words, and the scripts other than Latin. All digits count
        as one."""
        cps = np.where(_digits()[cps], 48, cps) if len(cps) else cps
        out = []
        for n in orders:
            h, at = cp.gram_hashes(cps, offs, n)
            out.append(((h & np.uint64(BUCKETS - 1)).astype(np.int64), at))
        h, at, _ = cp.word_hashes(cps, offs)
        out.append(((h & np.uint64(BUCKETS - 1)).astype(np.int64), at))
        script = _scripts()[cps] if len(cps) else np.zeros(0, np.int64)
        out.append((script[script > 0], np.concatenate([[0], np.cumsum(script > 0)])[offs]))
        return out

    @classmethod
    def train(cls, texts: list[str], labels: list[str], codes: tuple[str, ...] | None = None, orders: tuple[int, ...] = ORDERS) -> Model:
        """Fit on labelled texts; the codes are those of the labels, the usual nine first, in their order."""
        if codes is None:
            codes = tuple(sorted(set(labels), key=lambda c: (CODES.index(c) if c in CODES else len(CODES), c))) or CODES
        cps, offs = plain(*cp.from_texts(texts))
        which = np.array([codes.index(x) for x in labels], np.int64)
        tables = []
        for h, at in cls.features(cps, offs, orders):
            row = np.repeat(which, np.diff(at))
            counts = np.bincount(h * len(codes) + row, minlength=BUCKETS * len(codes)).reshape(BUCKETS, len(codes)).astype(np.float64)
            p = (counts + 0.02) / (counts.sum(0) + 0.02 * BUCKETS)
            logp = np.log(p)
            seen = counts.sum(1, keepdims=True) > 0
            tables.append(np.where(seen, logp - logp.mean(1, keepdims=True), 0).clip(-6, 6).astype(np.float32))
        return cls(codes, tables, orders)

    def scores(self, cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Centred log likelihood of each plain text (rows) under each language."""
        n = len(offs) - 1
        out = np.zeros((n, len(self.codes)), np.float32)
        for table, (h, at) in zip(self.tables, self.features(cps, offs, self.orders)):
            some = np.diff(at) > 0
            if some.any():
                out[some] += np.add.reduceat(table[h], at[:-1][some], axis=0)
        return out * TEMPER


def viterbi(emit: np.ndarray, first: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """Best label of each item; items of row i are first[i]:first[i+1]. All rows advance together, one position a step."""
    lens = np.diff(first)
    k = emit.shape[1]
    back = np.zeros(emit.shape, np.int8)
    best = np.zeros((len(lens), k), np.float32)
    live = np.flatnonzero(lens > 0)
    best[live] = emit[first[live]]
    t = 1
    while True:
        live = live[lens[live] > t]
        if not len(live):
            break
        step = best[live][:, :, None] + switch[None]
        at = first[live] + t
        back[at] = step.argmax(1)
        best[live] = step.max(1) + emit[at]
        t += 1
    out = np.zeros(len(emit), np.int8)
    live = np.flatnonzero(lens > 0)
    if len(live):
        out[first[live] + lens[live] - 1] = best[live].argmax(1)
    for t in range(int(lens.max(initial=0)) - 1, 0, -1):
        at = first[:-1][lens > t] + t
        out[at - 1] = back[at, out[at]]
    return out


@functools.cache
def _loaded(blob: bytes) -> Model:
    return pickle.loads(blob)


def train_from(samples: DataFrame, lang_col: str = "lang", text_col: str = "sample_text") -> Model:
    """Fit on labelled samples: at most MAX_SAMPLES of them, the first by their hash."""
    return Model.train(*labelled(samples, lang_col, text_col))


def labelled(samples: DataFrame, lang_col: str = "lang", text_col: str = "sample_text") -> tuple[list[str], list[str]]:
    """(texts, labels) of at most MAX_SAMPLES samples, the first by their hash."""
    rows = samples.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    rows = rows.orderBy(F.xxhash64(text_col), text_col, lang_col).limit(MAX_SAMPLES).collect()
    return [r[1] for r in rows], [r[0] for r in rows]


@functools.cache
def _scripts() -> np.ndarray:
    """A number for the script of each code point, by ranges; 0 for Latin and all else."""
    out = np.zeros(0x110000, np.int64)
    ranges = ((0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x77F), (0x900, 0xDFF), (0xE00, 0xE7F), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))
    for i, (a, b) in enumerate(ranges, 1):
        out[a : b + 1] = i
    out[0xF900:0xFB00] = out[0x20000:0x32000] = out[0x4E00]
    return out


@functools.cache
def _digits() -> np.ndarray:
    import unicodedata

    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x20000) if unicodedata.category(chr(c))[0] == "N"]] = True
    return out


def _word_counts(cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(cp.word_hashes(cps, offs)[1])


def _said(code: np.ndarray, k: int, error: float) -> np.ndarray:
    """Log evidence of named languages that are wrong with probability ``error``; none where nothing is named (-1)."""
    out = np.zeros((len(code), k))
    some = np.flatnonzero(code >= 0)
    out[some] = np.log(error / (k - 1))
    out[some, code[some]] = np.log(1 - error)
    return out


def fuse(model: Model, texts: pa.Array, prior: np.ndarray, declared: np.ndarray, suffix: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Segments of texts: (row, number within the row, start, end, language, confidence), in code points."""
    cps, offs = cp.flatten(texts)
    starts, first = sentence_offsets(cps, offs)
    pc, po = plain(cps, starts)
    like = model.scores(pc, po)
    # sentences of a single word say nothing beside others
    spoken = _word_counts(pc, po) > 1
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    like[~spoken & (np.bincount(row, spoken, len(offs) - 1)[row] > 0)] = 0
    k = len(model.codes)
    extra = np.log(prior) + _said(declared, k, ERROR)
    if suffix is not None:
        extra += _said(suffix, k, SUFFIX_ERROR)
    extra = extra.astype(np.float32)
    switch = np.full((k, k), np.log(SWITCH / (k - 1)), np.float32)
    np.fill_diagonal(switch, np.log(1 - SWITCH))
    # the evidence beside the text counts once a text: at its first sentence; the chain carries it on
    emit = like.copy()
    begin = first[:-1][np.diff(first) > 0]
    emit[begin] += extra[row[begin]]
    label = viterbi(emit, first, switch)
    if not len(label):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, np.zeros(0)
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(like, at, axis=0) + extra[row[at]]
    total -= total.max(1, keepdims=True)
    post = np.exp(total)
    post /= post.sum(1, keepdims=True)
    lang = label[at].astype(np.int64)
    seg_row = row[at]
    number = np.arange(len(at)) - np.searchsorted(seg_row, seg_row)
    spelt = np.concatenate([[0], np.cumsum((pc != 32) & ~_digits()[pc])])
    letters = np.add.reduceat(np.diff(spelt[po]), at)
    by_row = np.bincount(seg_row, letters, len(offs) - 1)
    ok = by_row[seg_row] > 0
    ends = np.append(starts[:-1][at][1:], starts[-1])
    base = offs[seg_row]
    conf = post[np.arange(len(at)), lang]
    return seg_row[ok], number[ok], (starts[:-1][at] - base)[ok], (ends - base)[ok], lang[ok], conf[ok].astype(np.float64)


SEGMENTS = "array<struct<seg_no:int,start_char:int,end_char:int,lang:string,confidence:double>>"


def _detector(model: Model):
    blob = pickle.dumps(model)

    def detect(batches):
        m = _loaded(blob)
        codes = {c: i for i, c in enumerate(m.codes)}
        names = np.array(m.codes, object)
        for batch in batches:
            text = batch.column(1)
            declared, suffix = (np.array([codes.get(x, -1) for x in batch.column(i).to_pylist()], np.int64) for i in (2, 5))
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            prior = np.asarray(flat, np.float64).reshape(len(text), len(codes))
            for lo, hi in cp.slices(text, 1_000_000):
                row, number, a, b, lang, conf = fuse(m, text.slice(lo, hi - lo), prior[lo:hi], declared[lo:hi], suffix[lo:hi])
                kinds = [pa.array(number, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(names[lang], pa.string()), pa.array(conf)]
                items = pa.StructArray.from_arrays(kinds, ["seg_no", "start_char", "end_char", "lang", "confidence"])
                offs = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(4).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(offs, items)], ["id", "field", "declared", "segments"])

    return detect


def host_priors(values: DataFrame, weight: float = 50.0, codes: tuple[str, ...] = CODES) -> DataFrame:
    """(host, prior: one probability per language) from values (host, declared), by one grouped aggregation and one sum of
    its groups."""
    counts = values.groupBy("host").agg(F.array(*(F.count_if(F.col("declared") == c) for c in codes)).alias("n"))
    corpus = counts.agg(F.array(*(F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(len(codes)))).alias("n")).scalar()
    total = lambda n: F.aggregate(n, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    smooth = F.zip_with("n", "corpus", lambda x, c: F.struct(x.alias("x"), (c + 20.0).alias("c")))
    by_host = counts.select("host", "n", corpus.alias("corpus")).select("host", total(F.col("n")).alias("mine"), smooth.alias("v"))
    whole = F.aggregate("v", F.lit(0.0), lambda acc, v: acc + v["c"])
    return by_host.select("host", "mine", "v", whole.alias("whole")).select("host", F.transform("v", lambda v: (v["x"] + weight * v["c"] / F.col("whole")) / (F.col("mine") + weight)).alias("prior"))


def detect_languages(df: DataFrame, id_col: str, fields: list[tuple[str, str]], host_col: str, samples: DataFrame, address_col: str | None = None) -> DataFrame:
    """(id, field, declared, segments) for each (text, label) of ``fields``; no segments where there is no language.

    The suffix evidence is that of ``address_col`` where it is given, else of the label's own region.
    """
    model = train_from(samples)
    parts = [F.struct(F.lit(t).alias("field"), F.col(t).alias("text"), declared_code(F.col(lab), model.codes).alias("declared"), suffix_code(F.col(address_col or lab)).alias("suffix")) for t, lab in fields]
    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(host_col, F.lit("")).alias("host"), F.explode(F.array(*parts)).alias("v")).select("id", "host", "v.*")
    priors = cut(host_priors(base.select("host", "declared"), codes=model.codes))
    live = base.where(F.col("text").isNotNull() & F.col("text").rlike(r"\S") & ~is_placeholder(F.col("text")))
    fed = live.join(broadcast_if_small(priors), "host").select("id", "text", "declared", "prior", "field", "suffix")
    return fed.mapInArrow(_detector(model), f"id bigint, field string, declared string, segments {SEGMENTS}")


def wrong_or_mixed(detected: DataFrame, id_col: str) -> DataFrame:
    """Segments of values whose label is missing, names no language or a wrong one, or whose text mixes languages."""
    n = F.size("segments")
    case = (n > 1) | (n == 1) & ~F.col("declared").eqNullSafe(F.element_at("segments", 1).getField("lang"))
    return detected.where((n > 0) & case).select(F.col("id").alias(id_col), "field", F.inline("segments"))


def prompt_detector(spark: SparkSession, tables: str):
    """A detector for the preprocessing plan: adds ``detected``, the language of the first segment of winner_prompt, or null."""
    samples = spark.read.parquet(f"{tables}/language_samples.parquet")

    def detector(df: DataFrame) -> DataFrame:
        found = detect_languages(df, "line_no", [("winner_prompt", "prompt_lang")], "source", samples)
        first = found.select(F.col("id").alias("line_no"), F.try_element_at("segments", F.lit(1))["lang"].alias("detected"))
        return df.join(first, "line_no", "left")

    return detector
