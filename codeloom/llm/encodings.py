"""Garbled text from a wrong character encoding.

A wrong decoding is a substitution cipher: under a code page that was wrongly used every
byte appears as one symbol. Which cipher damaged a word is unknown; so is, at the start,
how clean text of the corpus reads. Both are learned together by expectation-maximization
over the distinct words that hold a character outside ASCII, seeded by the code pages:

* before the EM each distinct word is read through each cipher once; its readings are kept;
* E step: every reading is weighed by bigrams of letters and by how common its cipher is in
  the word's source, which gives each reading a probability;
* M step: bigrams, the ciphers' shares per source, and for each source and page which letter
  its symbols stand for (the byte-to-letter mapping) are counted anew from these
  probabilities. A word that no single code page explains is read through the mapping its
  source has learned.

The EM runs until the expected shares no longer move. Words are counted per source in
Spark first, so that the model sees every document while each round costs a pass over
the kept readings of distinct words only. The letters are put back with ``translate()`` through the
table of the cipher; ciphers of several bytes a letter are then read by those bytes.
"""

from __future__ import annotations

import logging
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import groupby
from math import log

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import materialize

# Code pages of one byte, and of several, that text is commonly mistaken for.
SINGLE = ["cp1252", "cp1251", "cp1250", "koi8_r", "cp866", "iso8859_2", "iso8859_5", "cp437", "cp850", "cp852", "mac_roman"]
MULTI = ["euc_jp", "cp932", "gb18030", "big5", "euc_kr"]
SEEN_AS = ["cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8_r", "iso8859_2", "iso8859_5", "cp852", "cp1254"]
LOST = "\ufffd"
WORDS_PER_TASK = 5_000
CLEAN, LOSSY, LEARNED = "clean", "lossy", "learned>"
SEEN_LEAST = 1e-9  # bigrams rarer than this among all are left to the smoothing, which bounds the table
_NO_TEXT = re.compile("[\x7f-\x9f\ue000-\uf8ff\ufffd\ufeff]")  # unassigned, private or control characters


def ciphers() -> list[str]:
    """All ciphers as 'what it was>what it was read as'; '2' and '3' after utf_8: damaged so many times."""
    out = [f"utf_8{n}>{w}" for n in ("", "2", "3") for w in SEEN_AS if not n or w in ("cp1252", "mac_roman", "cp437", "cp1250", "cp1251")]
    out += [f"{m}>{w}" for m in MULTI for w in ("cp1252", "mac_roman", "cp437", "cp1251")]
    return out + [f"{t}>{w}" for t in SINGLE for w in SEEN_AS if t != w and not (t == "cp1252" and w in ("latin_1", "cp1254"))]


@lru_cache(maxsize=None)
def to_bytes(page: str) -> dict[int, str]:
    """Translation of the characters of a code page into its bytes, written as Latin-1."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(page))] = chr(b)
        except UnicodeDecodeError:
            pass
    if page.startswith("cp125"):  # bytes without a character pass through as C1 controls
        for b in range(128, 160):
            if chr(b) not in table.values():
                table[b] = chr(b)
    return table


def _runs_read(word: str, table: dict[int, str]) -> str | None:
    """A word of which the page holds a part only: runs of its characters are read as UTF-8 where they are that; null where none is."""
    out, changed = [], False
    for held, run in groupby(word, lambda c: c < "\x80" or ord(c) in table):
        piece = "".join(run)
        if held and not piece.isascii():
            try:
                piece, changed = piece.translate(table).encode("latin_1").decode("utf_8"), True
            except UnicodeError:
                pass
        out.append(piece)
    return "".join(out) if changed else None


def read_as(word: str, cipher: str) -> str | None:
    """The word under a cipher, or null where the cipher cannot have made it.

    Characters outside the page stay only beside damaged UTF-8, as text without spaces may be damaged in part.
    """
    true, page = cipher.split(">")
    times = int(true[-1]) if true.startswith("utf_8") and true[-1] in "23" else 1
    true = "utf_8" if true.startswith("utf_8") else true
    table = to_bytes(page)
    for _ in range(times):
        if not all(c < "\x80" or ord(c) in table for c in word):
            word = _runs_read(word, table) if true == "utf_8" else None
            if word is None:
                return None
            continue
        raw = word.translate(table)
        if true == "utf_8" and raw[-1:] in ("\xc2", "\xc3") and raw[-2:-1].islower():
            raw += "\xa0"  # white space that followed was normalized
        try:
            word = raw.encode("latin_1").decode(true)
        except UnicodeError:
            return None
        if word.isascii():
            return word if word.strip() else None
    return word


@lru_cache(maxsize=None)
def _tables() -> tuple[list[str], dict[str, tuple[frozenset, dict]]]:
    return ciphers(), {p: (frozenset(map(chr, to_bytes(p))), to_bytes(p)) for p in SEEN_AS}


def readings(word: str) -> list[tuple[str, str]]:
    """All (cipher, reading) of a word that could be text, each reading once, under the first cipher that gives it."""
    if word.isascii() or LOST in word:
        return []
    names, pages = _tables()
    odd, raw, out, seen = {c for c in word if c > "\x7f"}, {}, [], {word}
    for name in names:
        true, page = name.split(">")
        held, table = pages[page]
        if true.startswith("utf_8"):
            got = read_as(word, name) if not odd.isdisjoint(held) else None
        elif odd <= held:
            if page not in raw:
                raw[page] = word.translate(table).encode("latin_1")
            try:
                got = raw[page].decode(true)
            except UnicodeDecodeError:
                continue
        else:
            continue
        if got is not None and got not in seen and got.strip() and not _NO_TEXT.search(got):
            seen.add(got)
            out.append((name, got))
    return out


_FOLD = np.arange(128, dtype=np.uint32)  # bigrams see ASCII letters in lower case and digits alike
_FOLD[65:91] += 32
_FOLD[48:58] = 48


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words with both their ends, and where each word begins."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = np.where(codes < 128, _FOLD[np.minimum(codes, 127)], codes).astype(np.uint64)
    return folded, np.cumsum([0, *(len(w) + 2 for w in words)])


class Model:
    """Bigrams, the ciphers' shares per source, and the letters learned per source and page; grows with the alphabet only."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, shares: dict[tuple[str, str], float], letters: dict[tuple[str, str], dict[int, str]]):
        order = np.argsort(pairs)
        self.pairs, self.counts = pairs[order], counts[order]
        self.left, self.left_n = _sums(self.pairs >> np.uint64(32), self.counts)
        self.right, self.right_n = _sums(self.pairs & np.uint64(0xFFFFFFFF), self.counts)
        self.total = float(self.counts.sum()) + 1.0
        self.shares, self.letters = shares, letters
        self.of_source: Counter = Counter()
        for (s, _), n in shares.items():
            self.of_source[s] += n
        self.after: dict[int, dict[int, float]] = defaultdict(dict)  # what follows an ASCII letter, outside ASCII
        for p, n in zip(self.pairs.tolist(), self.counts.tolist()):
            if n >= 2 and p >> 32 < 128 and p & 0xFFFFFFFF > 127:
                self.after[p >> 32][p & 0xFFFFFFFF] = n

    def steps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Log frequency of bigrams among all of them. Not conditional on the first letter: a cipher keeps
        conditional frequencies, but damaged text stays rare beside the clean text, however much there is."""
        seen = _found(self.pairs, self.counts, (a << np.uint64(32)) | b)
        chance = np.minimum(1.0, _found(self.left, self.left_n, a) * _found(self.right, self.right_n, b) / self.total)
        return np.log((seen + 0.3 * chance + 1e-3) / self.total)

    def weigh(self, words: list[str]) -> np.ndarray:
        codes, begin = _codes(words)
        step = np.r_[self.steps(codes[:-1], codes[1:]), 0.0]
        step[begin[1:] - 1] = 0.0  # from the end of a word to the next one
        return np.add.reduceat(step, begin[:-1])

    def share(self, source: str, cipher: str) -> float:
        return log(self.shares.get((source, cipher), 0.0) / max(1.0, self.of_source[source]) + 2e-5)

    def lost(self, word: str) -> bool:
        """Whether a question mark inside an ASCII word stands for a lost letter: one that is common between its neighbours."""
        for i in range(1, len(word) - 1):
            if word[i] == "?" and word[i - 1].isalpha() and word[i + 1].isalpha():
                a, b = ord(word[i - 1].lower()), ord(word[i + 1].lower())
                fit = [x for x in self.after.get(a, ())]
                if not fit:
                    continue
                pair = lambda x, y: self.steps(np.array(x, dtype=np.uint64), np.array(y, dtype=np.uint64))
                kept = pair([a, 63], [63, b]).sum()
                ends = _found(self.pairs, self.counts, (np.array(fit, dtype=np.uint64) << np.uint64(32)) | np.uint64(b)) >= 2
                if (ends & (pair([a] * len(fit), fit) + pair(fit, [b] * len(fit)) > kept + 1.0)).any():
                    return True
        return False


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(keys, return_inverse=True)
    return names, np.bincount(at, weights=n, minlength=len(names))


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0.0)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [readings(w) for w in b["word"]]
        yield b.assign(ciphers=[[c for c, _ in g] for g in got], readings=[[r for _, r in g] for g in got])


def _sure_letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Letters of the words that no damage to UTF-8 could have made."""
    for b in batches:
        found: Counter = Counter()
        for w, cs, ns in zip(b["word"], b["ciphers"], b["ns"]):
            if not any(c.startswith("utf_8") for c in cs) and LOST not in w:
                for c in w:
                    if c > "\x7f":
                        found[c] += int(sum(ns))
        yield pd.DataFrame(list(found.items()), columns=["letter", "n"])


def _weighed(b: pd.DataFrame, model: Model | set) -> Iterator[tuple[str, str, int, list[tuple[str, str, float, float]]]]:
    """``word, source, n`` and for that source (cipher, reading, probability, odds against the word as it stands), clean first.

    At the start there is no model but an alphabet: a word whose symbols form valid UTF-8 under some
    code page is read so, if that gives known letters.
    """
    if isinstance(model, set):
        for w, cs, rs, ss, ns in zip(b["word"], b["ciphers"], b["readings"], b["sources"], b["ns"]):
            hit = next(((c, r) for c, r in zip(cs, rs) if c.startswith("utf_8") and model.issuperset(x for x in r if x > "\x7f")), None)
            for s, n in zip(ss, ns):
                yield w, s, int(n), [(CLEAN, w, 0.0 if hit else 1.0, 0.0), *([(*hit, 1.0, 0.0)] if hit else [])]
        return
    for c in range(0, len(b), 500):
        part = b.iloc[c : c + 500]
        extra = [_learned(w, set(rs), ss, model) for w, rs, ss in zip(part["word"], part["readings"], part["sources"])]
        texts = [t for w, rs, more in zip(part["word"], part["readings"], extra) for t in (w, *rs, *(r for _, _, r in more))]
        values, at = model.weigh(texts), 0
        for w, cs, rs, ss, ns, more in zip(part["word"], part["ciphers"], part["readings"], part["sources"], part["ns"], extra):
            stays, own = values[at] - (20.0 if _NO_TEXT.search(w) else 0.0), values[at + 1 : at + 1 + len(rs)]
            other = values[at + 1 + len(rs) : at + 1 + len(rs) + len(more)]
            at += 1 + len(rs) + len(more)
            for s, n in zip(ss, ns):
                if LOST in w or (w.isascii() and model.lost(w)):
                    yield w, s, int(n), [(CLEAN, w, 0.0, 0.0), (LOSSY, w, 1.0, 99.0 if LOST in w else 1.0)]
                    continue
                names = [CLEAN, *cs, *(x for t, x, _ in more if t == s)]
                read = [w, *rs, *(r for t, _, r in more if t == s)]
                score = np.array([stays, *own, *(v for v, (t, _, _) in zip(other, more) if t == s)]) + [model.share(s, x) for x in names]
                p = np.exp(score - score.max())
                p /= p.sum()
                keep = np.flatnonzero(p > 1e-3)
                yield w, s, int(n), [(names[i], read[i], float(p[i]), float(score[i] - score[0])) for i in (keep if keep[0] == 0 else np.r_[0, keep])]


def _learned(word: str, known: set, sources: list[str], model: Model) -> list[tuple[str, str, str]]:
    """(source, cipher, reading) of a word through what its sources have learned, where no code page reads it so."""
    out = []
    for s in sources:
        for page in model.letters.get(s, ()):
            table = model.letters[s][page]
            if all(c < "\x80" or ord(c) in table for c in word) and not word.isascii():
                got = word.translate(table)
                if got != word and got not in known:
                    out.append((s, LEARNED + page, got))
    return out


def _count(batches: Iterator[pd.DataFrame], held: Broadcast) -> Iterator[pd.DataFrame]:
    """Expected counts over a batch: bigrams ('b'), ciphers per source ('s'), letters per source, page and symbol ('m')."""
    for b in batches:
        pairs: Counter = Counter()
        shares: Counter = Counter()
        letters: Counter = Counter()
        texts: Counter = Counter()
        for w, s, n, got in _weighed(b, held.value):
            for cipher, r, p, _ in got:
                if p <= 0:
                    continue
                shares[s, cipher] += n * p
                if LOST not in r:
                    texts[r] += n * p
                true, _, page = cipher.partition(">")
                if len(r) == len(w) and (true in SINGLE or true == "learned"):
                    for x, y in zip(w, r):
                        if x > "\x7f":
                            letters[s, page + x, y] += n * p
        if texts:
            codes, begin = _codes(list(texts))
            weight = np.repeat(np.fromiter(texts.values(), float, len(texts)), np.diff(begin))
            inside = np.ones(len(codes), dtype=bool)
            inside[begin[1:] - 1] = False
            at = np.flatnonzero(inside)
            names, n = _sums((codes[at] << np.uint64(32)) | codes[at + 1], weight[at])
            pairs.update(dict(zip(names.view(np.int64).tolist(), n.tolist())))
        rows = [("b", "", "", "", k, n) for k, n in pairs.items()] + [("s", s, c, "", 0, n) for (s, c), n in shares.items()] + [("m", s, c, y, 0, n) for (s, c, y), n in letters.items()]
        yield pd.DataFrame(rows, columns=["kind", "source", "symbol", "letter", "pair", "n"])


def _model(cached: DataFrame, model: Model | set) -> Model:
    """The M step: expected counts under a model, gathered into the next one."""
    held = cached.sparkSession.sparkContext.broadcast(model)
    stats = cached.mapInPandas(partial(_count, held=held), "kind string, source string, symbol string, letter string, pair long, n double")
    stats = materialize(stats.groupBy("kind", "source", "symbol", "letter", "pair").agg(F.sum("n").alias("n")), "counts")
    pairs = stats.where("kind = 'b'").select("pair", "n")
    total = pairs.agg(F.sum("n")).first()[0] or 0.0
    pairs = pairs.where(F.col("n") > total * SEEN_LEAST).toPandas()  # at most the alphabet squared, and no more than 1 / SEEN_LEAST
    shares, letters = {}, {}
    for r in stats.where("kind = 's'").collect():  # a number per source and cipher
        shares[r.source, r.symbol] = r.n
    best: dict = {}
    for r in stats.where("kind = 'm' and n >= 1").collect():  # at most a number per source, page, byte and code page
        key = (r.source, r.symbol[:-1], r.symbol[-1])
        if r.n > best.get(key, (0.0, ""))[0]:
            best[key] = (r.n, r.letter)
    for (s, page, x), (_, y) in best.items():
        letters.setdefault(s, {}).setdefault(page, {})[ord(x)] = y
    return Model(pairs["pair"].to_numpy(dtype=np.int64).view(np.uint64), pairs["n"].to_numpy(dtype=float), shares, letters)


def _decide(batches: Iterator[pd.DataFrame], held: Broadcast) -> Iterator[pd.DataFrame]:
    """The likeliest reading of each word in each of its sources."""
    for b in batches:
        rows = []
        for w, s, n, got in _weighed(b, held.value):
            cipher, r, _, odds = max(got, key=lambda g: g[2])
            rows.append((s, w, n, cipher, r, odds))
        yield pd.DataFrame(rows, columns=["source", "word", "n", "cipher", "reading", "odds"])


_READ = "source string, word string, n long, cipher string, reading string, odds double"


def words_of(documents: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Words (split at ASCII white space) that hold a character outside ASCII or a question mark between letters."""
    return (
        documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.lower(F.trim(F.col(source))), F.lit("")).alias("source"), F.col(text).alias("text"))
        .where(F.col("text").rlike("[^\\x00-\\x7f]|[A-Za-z]\\?[A-Za-z]"))
        .select("doc_id", "source", F.explode(F.array_distinct(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w.rlike("[^\\x00-\\x7f]|^[^=&/<>]*[A-Za-z]\\?[A-Za-z]")))).alias("word"))
    )


def learn_readings(words: DataFrame, settled: float = 1e-4) -> DataFrame:
    """``source, word, n, cipher, reading, odds`` per distinct word and source, after EM until the shares are settled.

    At the start, letters are known from the words that no damage to UTF-8 could have made.
    The EM ends when no more than ``settled`` of the words' weight moves between ciphers in a round, or
    when a round moves no less than the one before it; the number of rounds is logged.
    """
    distinct = words.groupBy("source", "word").agg(F.count("*").alias("n"))
    distinct = materialize(distinct.groupBy("word").agg(F.collect_list("source").alias("sources"), F.collect_list("n").alias("ns")), "words")
    # Few bytes, much work: spread by the number of words, not by their size.
    parts = max(2 * words.sparkSession.sparkContext.defaultParallelism, distinct.count() // WORDS_PER_TASK)
    shape = "word string, sources array<string>, ns array<long>, ciphers array<string>, readings array<string>"
    cached = materialize(distinct.repartition(parts, "word").mapInPandas(_candidates, shape), "candidates")
    letters = cached.mapInPandas(_sure_letters, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n")).where("n > 1")
    model, before, moved, rounds = _model(cached, {r.letter for r in letters.collect()}), float("inf"), 0.0, 1
    while True:
        new = _model(cached, model)
        rounds += 1
        moved = sum(abs(new.shares.get(k, 0.0) - model.shares.get(k, 0.0)) for k in new.shares.keys() | model.shares.keys()) / 2
        model = new
        if moved <= settled * sum(model.shares.values()) or moved >= before:
            break
        before = moved
    logging.getLogger(__name__).info("EM settled after %d rounds; the last one moved %.1f words", rounds, moved)
    held = words.sparkSession.sparkContext.broadcast(model)
    return materialize(cached.mapInPandas(partial(_decide, held=held), _READ), "readings")


def _letters(word: str) -> Column:
    """A word without case and without what stands around its letters."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}]+|[^\p{L}]+$", ""))


def damaged_words(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", min_odds: float = 0.0) -> DataFrame:
    """``doc_id, word, cipher, reading`` for every word of a document that a wrong decoding made.

    One row per document and word, however often a document is delivered. Cipher ``lossy`` marks words that hold a replacement for a lost character; their
    reading is the word itself. Null and empty texts give no row; a null source is a source.

    A word under a weak cipher (one byte a letter, or less than three letters of several bytes) is
    believed if another word of its text was damaged too, if its reading stands undamaged elsewhere
    in the corpus (three letters at least), or if its odds are beyond chance: above the number of
    distinct words times the number of ciphers (under several bytes a letter: and its reading stands
    elsewhere). Odds hold the cipher's share in the source.
    """
    words = materialize(words_of(documents, doc_id, text, source), "docwords")
    read = learn_readings(words)
    learned = read.where((F.col("cipher") != CLEAN) & (F.col("odds") > min_odds)).select("source", "word", "cipher", "reading", "odds")
    found = materialize(words.join(learned, ["source", "word"]).groupBy("doc_id", "word", "cipher", "reading").agg(F.max("odds").alias("odds")), "damaged")
    # A cipher of one byte a letter leaves no structure in a word, nor does a single character of two.
    true = F.substring_index("cipher", ">", 1)
    weak = true.isin(*SINGLE, "learned") | (true.isin(MULTI) & (F.length("reading") < 3))
    several = found.where(F.col("cipher") != LOSSY).groupBy("doc_id").agg(F.countDistinct("word").alias("_n")).where("_n > 1").select("doc_id", F.lit(True).alias("_several"))
    known = read.where(F.col("cipher") == CLEAN).select(_letters("word").alias("_letters")).where("_letters <> ''").distinct().withColumn("_known", F.lit(True))
    chance = log(max(1, read.count()) * len(ciphers()))  # odds that so many trials may reach by chance
    unsure = found.where(weak).withColumn("_letters", _letters("reading")).join(several, "doc_id", "left").join(known, "_letters", "left")
    rare = (F.col("odds") > chance) & (true.isin(*SINGLE, "learned") | F.col("_known"))  # several bytes a letter: the shorter reading alone raises the odds
    believed = unsure.where(rare | F.col("_several") | (F.col("_known") & (F.length("_letters") > 2)))
    return found.where(~weak).unionByName(believed.select(*found.columns)).drop("odds")


@F.pandas_udf(T.StringType())
def _replace(text: pd.Series, words: pd.Series) -> pd.Series:
    def one(t: str, ws) -> str:
        new = {w["word"]: w["reading"] for w in ws}
        out, start = [], 0
        for i, c in enumerate(t + " "):
            if c in " \t\n\r":
                piece = t[start:i]
                out.append(new.get(piece, piece))
                if i < len(t):
                    out.append(c)
                start = i + 1
        return "".join(out)

    return pd.Series([one(t, w) for t, w in zip(text, words)])


def restore(documents: DataFrame, damaged: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, ciphers``: the damaged documents with their words put right; all else stays as it was."""
    per_doc = damaged.groupBy("doc_id").agg(F.collect_set(F.struct("word", "reading")).alias("words"), F.sort_array(F.collect_set("cipher")).alias("ciphers"))
    fixed: Column = _replace(F.col(text), F.col("words"))
    return documents.join(per_doc, documents[doc_id] == per_doc["doc_id"]).select(per_doc["doc_id"], fixed.alias("text"), F.array_join("ciphers", ",").alias("ciphers"))
