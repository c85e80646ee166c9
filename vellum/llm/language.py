"""Language spans: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Each language has a model of character n-grams (1 to 3, with word edges) counted over all training
documents. The scripts of a word's letters leave as candidates the languages that the training texts
write in that script. The best labelling of a text's words maximises the sum of word scores less a
penalty for each switch of language; runs of one label are the spans.

Every n-gram of every language scores. A table that is small is broadcast; of a larger one the n-grams
that each chunk of texts holds are joined to it, with the same scores.

Defined results: a null text, or one without letters, is ``und`` with score 0; a text whose script no
learned language uses keeps all candidates; ties go to the language that sorts first; with nothing to
learn from everything is ``und``; repeated rows are labelled alike; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import byte_slices, dropped, fold_of, saved

SWITCH = 12.0
#: Score of a language that a word's script rules out: no sum of scores and switches comes near it.
EXCLUDED = -1e9
MAX_GRAMS = 60_000
MAX_LANGUAGES = 512
CACHE_WORDS = 300_000
SLICE_BYTES = 8_000_000
MIN_SCRIPT_SHARE = 0.02
# First and last code points of the blocks of a script (Unicode).
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7A3)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}


_NAMES = ["other", *SCRIPTS]
#: By code point: -2 not looked up yet, -1 no letter, 0 a letter without a script, else the script's place in _NAMES.
_KIND = np.full(0x110000, -2, np.int8)
#: White space stands for the edges of words, as no word holds any.
_START, _END = ord("\n"), ord("\r")


def _kind(point: int) -> int:
    if not chr(point).isalpha():
        return -1
    if point < 0x250:
        return _NAMES.index("latin")
    return next((_NAMES.index(name) for name, ranges in SCRIPTS.items() if any(a <= point <= b for a, b in ranges)), 0)


class Words:
    """Words in lower case, of letters only, as one array of code points between edges.

    ``start`` has the place of each word's first edge, ``letters`` its number of letters and ``script``
    the script of its first letter that has one (0: none). grams() gives the codes of the 1-, 2- and
    3-grams that begin at each place, three times 21 bits, 0 where none begins.
    """

    def __init__(self, words: list[str]):
        text = "\n" + "\r\n".join(words) + "\r"
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KIND[points]
        if (kind == -2).any():
            for p in np.unique(points[kind == -2]).tolist():
                _KIND[p] = _kind(p)
            kind = _KIND[points]
        keep = (kind >= 0) | (points == _START) | (points == _END)
        self.points, kind = points[keep].astype(np.uint64), kind[keep]
        self.start = np.nonzero(self.points == _START)[0]
        self.letters = np.diff(np.append(self.start, len(self.points))) - 2
        self.script = np.zeros(len(words), np.int8)
        known = np.nonzero(kind > 0)[0][::-1]
        self.script[np.searchsorted(self.start, known, side="right") - 1] = kind[known]  # the first comes last

    def grams(self) -> list[np.ndarray]:
        c = np.concatenate((self.points, np.zeros(2, np.uint64)))
        one, two, three = c[:-2], c[1:-1], c[2:]
        letter = (one != _START) & (one != _END)
        pair = (one != _END) & (letter | (two != _END))
        both = one | two << np.uint64(21)
        triple = pair & (two != _END)
        return [np.where(letter, one, 0), np.where(pair, both, 0), np.where(triple, both | three << np.uint64(42), 0)]


def gram_text(code: int) -> str:
    """A gram as text, edges as ^ and $."""
    parts = [code & 0x1FFFFF, code >> 21 & 0x1FFFFF, code >> 42]
    return "".join("^" if x == _START else "$" if x == _END else chr(x) for x in parts if x)


def gram_code(text: str) -> int:
    return sum((_START if c == "^" else _END if c == "$" else ord(c)) << 21 * k for k, c in enumerate(text))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over every word of every document given; a gram "\\x00script" counts words of a script."""

    def count(batches):
        words: dict[str, Counter] = {}

        def out():
            langs, keys, counts = [], [], []
            for lang, seen in words.items():
                w = Words(list(seen))
                times = np.fromiter(seen.values(), np.int64, len(seen))
                at = np.repeat(times, w.letters + 2)
                for codes in w.grams():
                    some = codes > 0
                    c, back = np.unique(codes[some], return_inverse=True)
                    keys += map(gram_text, c.tolist())
                    counts += np.bincount(back, at[some], len(c)).astype(np.int64).tolist()
                of = np.bincount(w.script[w.letters > 0], times[w.letters > 0], len(_NAMES)).astype(np.int64)
                keys += ["\0" + _NAMES[k] for k in np.nonzero(of)[0]]
                counts += of[of > 0].tolist()
                langs += [lang] * (len(keys) - len(langs))
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, words.values())) > 500_000:
                yield out()
        yield out()

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    return known.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Scores of words for each language, in order of the languages' names."""

    def __init__(self, counts: pd.DataFrame, max_words: int = CACHE_WORDS, sums: dict[int, np.ndarray] | None = None):
        """counts: those of gram_counts(), or of some n-grams and all scripts with ``sums``: by length, each language's smoothed sum over all n-grams."""
        script = counts["gram"].str.startswith("\0")
        self.langs = sorted(counts["lang"].unique())
        at = {x: i for i, x in enumerate(self.langs)}
        self.scripts: dict[str, np.ndarray] = {}
        for s, rows in counts[script].groupby("gram"):
            v = np.zeros(len(self.langs))
            v[[at[x] for x in rows["lang"]]] = rows["n"]
            self.scripts[s[1:]] = v
        total = sum(self.scripts.values()) if self.scripts else np.ones(len(self.langs))
        self.scripts = {s: v >= MIN_SCRIPT_SHARE * np.maximum(total, 1) for s, v in self.scripts.items()}
        table = counts[~script].pivot_table(index="gram", columns="lang", values="n", fill_value=0, aggfunc="sum").reindex(columns=self.langs, fill_value=0)
        size = table.index.str.len().to_numpy() if len(table) else np.zeros(0, int)
        n = table.to_numpy(float)
        p = np.zeros_like(n)
        for k in (1, 2, 3):
            rows = size == k
            if rows.any():
                part = n[rows] + 0.5
                p[rows] = np.log(part / (part.sum(axis=0) if sums is None else sums[k]))
        # what all languages share says nothing
        p -= p.mean(axis=1, keepdims=True) if len(p) else 0
        codes = np.array([gram_code(g) for g in table.index], np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.table = np.vstack((p[order], np.zeros(len(self.langs))))
        allowed = [self.scripts.get(x) if k else None for k, x in enumerate(_NAMES)]
        self.off = np.array([np.where(a, 0.0, EXCLUDED) if a is not None and a.any() else np.zeros(len(self.langs)) for a in allowed])
        # wide scores: fewer words and texts at a time
        self.max_words = min(max_words, max(1, 20_000_000 // max(1, len(self.langs))))
        self.step = max(16, min(1024, 32_768 // max(1, len(self.langs))))
        self.fresh = max(256, min(50_000, 2_000_000 // max(1, len(self.langs))))
        self.number: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.number.clear()
        self.scores = np.zeros((1024, len(self.langs)))
        self.letters = np.zeros(1024, np.int64)

    def learn(self, words: list[str]) -> None:
        """Scores of new words, worked out together."""
        if not words:
            return
        w, start, none = Words(words), len(self.number), len(self.codes)
        at = np.zeros((len(w.points), len(self.langs)))
        if none:
            for codes in w.grams():
                place = np.searchsorted(self.codes, codes)
                found = self.codes[np.minimum(place, none - 1)] == codes
                at += self.table[np.where(found, place, none)]
        new = np.add.reduceat(at, w.start, axis=0) + self.off[w.script]
        self.number.update(zip(words, range(start, start + len(words)), strict=True))
        need = start + len(words)
        if need > len(self.scores):
            room = max(need, 2 * len(self.scores)) - len(self.scores)
            self.scores = np.vstack((self.scores, np.zeros((room, len(self.langs)))))
            self.letters = np.concatenate((self.letters, np.zeros(room, np.int64)))
        self.scores[start:need] = new
        self.letters[start:need] = w.letters

    def learn_texts(self, texts: list[str | None]) -> None:
        """Scores of the words of these texts, worked out for many texts together."""
        fresh: dict[str, None] = {}
        for text in texts:
            if text:
                fresh.update(dict.fromkeys(w for w in text.split() if w not in self.number))
            if len(fresh) >= self.fresh:
                self.learn(list(fresh))
                fresh.clear()
        self.learn(list(fresh))

    def ids(self, words: list[str]) -> np.ndarray:
        number = self.number
        try:
            return np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn([w for w in dict.fromkeys(words) if w not in number])
            return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best labels of each text's words; texts advance together, word by word."""
    out: list[np.ndarray] = [np.zeros(len(s), np.int32) for s in scores]
    hard = []
    for k, s in enumerate(scores):
        if not len(s):
            continue
        total = s.sum(axis=0)
        best = int(total.argmax())
        # no switching can gain more than the words' regrets against the best language
        if (s.max(axis=1) - s[:, best]).sum() <= switch:
            out[k][:] = best
        else:
            hard.append(k)
    hard.sort(key=lambda k: -len(scores[k]))
    if not hard:
        return out
    n, longest = len(hard), len(scores[hard[0]])
    lengths = np.array([len(scores[k]) for k in hard])
    state = np.array([scores[k][0] for k in hard])
    back: list[np.ndarray] = []
    ends = np.zeros((n, state.shape[1]))
    flat = np.concatenate([scores[k] for k in hard])
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    lives = np.searchsorted(-lengths, -np.arange(longest + 1), side="left").tolist()  # texts longer than t
    active = n
    for t in range(1, longest + 1):
        still = lives[t]
        if still < active:
            ends[still:active] = state[still:active]
            active = still
        if not active:
            break
        state = state[:active]
        best = state.argmax(axis=1)
        jump = state.max(axis=1)[:, None] - switch
        go = jump > state
        back.append(np.where(go, best[:, None], -1).astype(np.int32))
        state = np.where(go, jump, state) + flat[begin[:active] + t]
    label = ends.argmax(axis=1)
    labels = np.zeros(len(flat), np.int32)
    for t in range(longest - 1, -1, -1):
        live = lives[t]
        labels[begin[:live] + t] = label[:live]
        if t:
            b = back[t - 1]
            b = b[np.arange(live), label[:live]]
            label[:live] = np.where(b >= 0, b, label[:live])
    for k, lo, size in zip(hard, begin.tolist(), lengths.tolist(), strict=True):
        out[k][:] = labels[lo : lo + size]
    return out


def gram_sums(grams: DataFrame, langs: list[str]) -> dict[int, np.ndarray]:
    """By length of n-grams, each language's count of all of them with the 0.5 that each is given."""
    sizes = {r[0]: r[1] for r in grams.select("gram").distinct().groupBy(F.length("gram")).count().collect()}
    out = {k: np.full(len(langs), 0.5 * n) for k, n in sizes.items()}
    at = {x: i for i, x in enumerate(langs)}
    for k, lang, n in grams.groupBy(F.length("gram"), "lang").agg(F.sum("n")).collect():
        out[k][at[lang]] += n
    return out


def _chunked(docs: DataFrame, size: int) -> DataFrame:
    """(chunk, doc_id, text): chunks of at most ``size`` rows."""

    def number(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = (n + np.arange(batch.num_rows, dtype=np.int64)) // size
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(task << 32 | at), batch.column(0), batch.column(1)], names=["chunk", "doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(number, "chunk long, doc_id long, text string")


def _asked(chunks: DataFrame) -> DataFrame:
    """(chunk, gram): the n-grams of each chunk's words, mostly once."""

    def ask(batches):
        for batch in batches:
            for chunk, rows in batch.to_pandas().groupby("chunk"):
                words: set[str] = set()
                for text in rows["text"]:
                    words.update(text.split() if text else ())
                if words:
                    codes = np.unique(np.concatenate(Words(sorted(words)).grams()))
                    grams = [gram_text(c) for c in codes[codes > 0].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(grams), pa.int64()), pa.array(grams, pa.string())], names=["chunk", "gram"])

    return chunks.mapInArrow(ask, "chunk long, gram string").distinct()


def language_spans(docs: DataFrame, train: DataFrame, switch: float = SWITCH, max_grams: int = MAX_GRAMS, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """doc_id, lang_pred, score and spans: an array of (lang, from_word, to_word, letters).

    score is the share of the text's letters that lie in spans of the predicted language. A table of more
    than ``max_grams`` n-grams or ``max_languages`` languages is not broadcast but joined.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,from_word:int,to_word:int,letters:int>>"
    counts = saved(gram_counts(train), "grams")
    of_script = F.col("gram").startswith("\0")
    grams = counts.where(~of_script)
    n_grams, n_langs = grams.select("gram").distinct().count(), counts.select("lang").distinct().count()

    def labelled(m: LanguageModel, ids: pa.Array, texts: pa.Array):
        for part in byte_slices(pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"]), 1, SLICE_BYTES):
            for lo in range(0, part.num_rows, m.step):
                if len(m.number) > m.max_words:
                    m.reset()
                some = part.slice(lo, m.step)
                yield _label(m, some.column(0), some.column(1).to_pylist(), switch)

    if n_grams <= max_grams and n_langs <= max_languages:
        model = LanguageModel(counts.toPandas())
        dropped(spark, counts)
        held = spark.sparkContext.broadcast(model)

        def label(batches):
            for batch in batches:
                yield from labelled(held.value, batch.column(0), batch.column(1))

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(label, schema)

    scripts = counts.where(of_script).toPandas()
    fixed = spark.sparkContext.broadcast((scripts, gram_sums(grams, sorted(scripts["lang"].unique()))))
    chunks = saved(_chunked(docs, max(64, min(2048, 65_536 // n_langs))), "chunks")
    answers = _asked(chunks).join(grams, "gram").select("chunk", "lang", "gram", "n")

    def judge(texts: pa.Table, found: pa.Table) -> pa.Table:
        names, sums = fixed.value
        m = LanguageModel(pd.concat([names, found.select(["lang", "gram", "n"]).to_pandas()], ignore_index=True), sums=sums)
        texts = texts.combine_chunks()
        parts = [p for b in texts.to_batches() for p in labelled(m, b.column("doc_id"), b.column("text"))]
        return pa.Table.from_batches(parts, _SPANS)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, schema)


_SPAN = pa.struct([("lang", pa.string()), ("from_word", pa.int32()), ("to_word", pa.int32()), ("letters", pa.int32())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def _label(m: LanguageModel, doc_ids: pa.Array, texts: list, switch: float) -> pa.RecordBatch:
    if m.langs:
        m.learn_texts(texts)
    rows, words = [], [m.ids(t.split()) if t and m.langs else np.zeros(0, np.int64) for t in texts]
    paths = viterbi([m.scores[w] for w in words], switch)
    for w, path in zip(words, paths, strict=True):
        letters = m.letters[w]
        total = int(letters.sum())
        if not total:
            rows.append(("und", 0.0, []))
            continue
        cut = np.concatenate(([0], np.nonzero(np.diff(path))[0] + 1, [len(path)]))
        sums = np.add.reduceat(letters, cut[:-1])
        per = np.bincount(path[cut[:-1]], sums, len(m.langs))
        best = int(per.argmax())
        spans = [{"lang": m.langs[path[a]], "from_word": int(a), "to_word": int(b), "letters": int(n)} for a, b, n in zip(cut[:-1], cut[1:], sums, strict=True)]
        rows.append((m.langs[best], float(per[best] / total), spans))
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SPANS.types[1:], strict=True))], schema=_SPANS)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_spans(docs, docs.where(fold_of("doc_id", 4) != 2))
    return out.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
