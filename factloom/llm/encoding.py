"""Finding and undoing wrong character encodings.

A character n-gram model is trained on clean records: those without control or
replacement characters in which no run reads as misdecoded UTF-8, and which a first model
of such records reads as they stand. Every run of characters
between ASCII blanks that holds a non-ASCII character is then taken through every chain
that encodes it by the code page it may have been read with and decodes it by the one it
may have been written in, UTF-8 chains up to three times over. The likeliest reading is
accepted if it beats the text as it stands by a margin that is validated at training:
at most one in 1,000 clean texts held out may pass it.

All counts cover all records, copies once. The n-grams are hashed into tables of fixed size, so what
goes to the driver and to the workers is bounded whatever the corpus.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import reliable_checkpoint

# Code pages a text may have been read with, and those it may have been written in, by script.
READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp437", "cp850", "mac_roman", "iso8859-15", "cp1254", "cp1253", "cp1257", "cp874", "gbk", "big5", "cp932", "euc_jp", "euc_kr")
WRITTEN_IN = {
    "western": ("cp1252", "mac_roman", "cp850"),
    "central": ("cp1250", "iso8859-2", "cp852"),
    "cyrillic": ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"),
    "thai": ("cp874",),
    "multibyte": ("gbk", "big5", "cp932", "euc_jp", "euc_kr"),
}
MULTIBYTE = ("gbk", "big5", "cp932", "euc_jp", "euc_kr")
RUN = re.compile(r"(?<![^\x00-\x20])[\x21-\x7f]*[^\x00-\x7f][^\x00-\x20]*")
BROKEN = re.compile("[\x80-\x9f�]")
NON_ASCII = re.compile(r"[^\x00-\x7f]")
STRAY = re.compile("[\udc80-\udcff]")
UTF8_LEAD = re.compile(rb"[\xc2-\xf4][\x80-\xbf]")
CONTROL = re.compile(r"[\x00-\x1f]")
WIDE = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\ufe30-\ufe4f\uff00-\uffef]")
SUBRUN = re.compile("[\u0900-\u0e7f\u2e80-\ud7ff\uf900-\ufaff\ufe30-\uffef]+|[^\u0900-\u0e7f\u2e80-\ud7ff\uf900-\ufaff\ufe30-\uffef]+")
TRIGRAMS, BIGRAMS, UNIGRAMS = 1 << 20, 1 << 18, 1 << 16
SLOTS = TRIGRAMS + BIGRAMS + UNIGRAMS
FOLDS, FALSE_SHARE = 16, 1_000
WHOLE_SHARE, WHOLE_RUNS, WHOLE_MARGINS = 0.8, 4, 3
LEAST_MARGIN, MOST_MARGIN = 4.0, 13.0


@lru_cache(None)
def _charmap(page: str) -> tuple[object, frozenset[str]]:
    """How a one-byte `page` encodes, with the bytes it leaves undefined standing for themselves, and what it can encode."""
    table = []
    for byte in range(256):
        try:
            table.append(bytes([byte]).decode(page))
        except UnicodeDecodeError:
            table.append(chr(byte))
    return codecs.charmap_build("".join(table)), frozenset(table)


def encoded(run: str, page: str) -> bytes | None:
    """The bytes that `page` reads as `run`, or None; bytes it leaves undefined stand for themselves."""
    try:
        return run.encode(page) if page in MULTIBYTE else codecs.charmap_encode(run, "strict", _charmap(page)[0])[0]
    except UnicodeEncodeError:
        return None


@lru_cache(50_000)
def possible_pages(run: str) -> tuple[str, ...]:
    """The pages of READ_AS that `run` may have been read with."""
    own = frozenset(run)
    wide = WIDE.search(run) is not None
    return tuple(p for p in READ_AS if (wide if p in MULTIBYTE else not wide and own <= _charmap(p)[1]))


def shape(run: str) -> str:
    """`run` with every digit alike: no chain changes digits, so they say nothing about one."""
    for digit in "123456789":
        run = run.replace(digit, "0")
    return run


def shapes(text: str) -> list[str]:
    """The shapes of the runs of `text`."""
    return [r for r in CONTROL.sub(" ", shape(text)).split(" ") if not r.isascii()]


def _decoded(data: bytes, page: str) -> str | None:
    try:
        return data.decode(page)
    except UnicodeDecodeError:
        return None


@lru_cache(None)
def _written_in(read_as: str) -> tuple[str, ...]:
    if read_as in MULTIBYTE:
        return ()
    pages = [p for group in WRITTEN_IN.values() for p in group]
    return tuple(p for p in pages if codecs.lookup(p).name != codecs.lookup(read_as).name)


def _utf8(data: bytes, page: str) -> str | None:
    """`data` as UTF-8. Bytes that fit no sequence stay as `page` reads them, if three times as many characters do fit."""
    if (text := _decoded(data, "utf-8")) is not None:
        return text
    text = data.decode("utf-8", "surrogateescape")
    stray = STRAY.findall(text)
    if 3 * len(stray) > len(NON_ASCII.findall(text)) - len(stray):
        return None
    return STRAY.sub(lambda m: bytes([ord(m[0]) - 0xDC00]).decode(page, "replace"), text)


def utf8_readings(run: str, strict: bool = False) -> dict[str, str]:
    """Readings of `run` as UTF-8 read with a code page, by chain."""
    found = {}
    for page in possible_pages(run):
        data = encoded(run, page)
        if data is not None and UTF8_LEAD.search(data) and (text := _decoded(data, "utf-8") if strict else _utf8(data, page)) is not None and text != run:
            found[f"{page}>utf-8"] = text
    return found


def reread(run: str, chain: str) -> str | None:
    """`run` taken through `chain`, or None where it can't be."""
    text: str | None = run
    for step in chain.split():
        page, written = step.split(">")
        data = encoded(text, page)
        text = None if data is None else _utf8(data, page) if written == "utf-8" else _decoded(data, written)
        if text is None:
            return None
    return text


def readings(run: str, part: bool = False) -> dict[str, str]:
    """Every other reading of `run`: by chain, one text each; equal texts keep the first chain.

    Of a `part` of a run, which has no ends of its own, only the UTF-8 chains are tried.
    """
    found: dict[str, str] = {}
    level = utf8_readings(run)
    for _ in range(3):
        found |= {chain: text for chain, text in level.items() if chain not in found}
        level = {f"{chain} {more}": text for chain, inner in level.items() if not inner.isascii() for more, text in utf8_readings(inner).items()}
        if not level:
            break
    for page in () if part else possible_pages(run):
        if page not in MULTIBYTE and (data := encoded(run, page)) is not None:
            for written in _written_in(page):
                if (text := _decoded(data, written)) is not None and text != run:
                    found[f"{page}>{written}"] = text
    unique: dict[str, str] = {}
    for chain, text in found.items():
        if not BROKEN.search(text):
            unique.setdefault(text, chain)
    return {chain: text for text, chain in unique.items()}


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every character of every text and of its end: slots of its trigram, the bigram before, its bigram, the character before, itself; and last the text it is of."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    codes = np.frombuffer("\x03".join(["\x02\x02" + shape(t) for t in texts] + [""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths + 2)
    keep = np.ones(len(codes), bool)
    keep[(ends - lengths - 2)] = False
    keep[(ends - lengths - 1)] = False
    at = np.flatnonzero(keep)
    a, b, c = codes[at - 2], codes[at - 1], codes[at]
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        tri = ((((a * mix + b) * mix + c) * mix) >> np.uint64(44)).astype(np.int64)
        context = TRIGRAMS + (((a * mix + b) * mix) >> np.uint64(46)).astype(np.int64)
        bi = TRIGRAMS + (((b * mix + c) * mix) >> np.uint64(46)).astype(np.int64)
    before = TRIGRAMS + BIGRAMS + (b % np.uint64(UNIGRAMS)).astype(np.int64)
    own = TRIGRAMS + BIGRAMS + (c % np.uint64(UNIGRAMS)).astype(np.int64)
    return np.stack([tri, context, bi, before, own]), np.repeat(np.arange(len(texts)), lengths)


@dataclass(frozen=True)
class CharModel:
    """Smoothed trigram model over hashed counts, and the margin a reading must win by."""

    counts: np.ndarray
    margin: float = LEAST_MARGIN
    weight: float = 2.0

    def log_likelihood(self, texts: list[str]) -> np.ndarray:
        """Natural log of the probability of each text."""
        if not texts:
            return np.empty(0)
        (tri, context, bi, before, own), of = _grams(texts)
        n, w = self.counts, self.weight
        total = n[TRIGRAMS + BIGRAMS :].sum()
        p1 = (n[own] + 0.05) / (total + 0.05 * UNIGRAMS)
        p2 = (n[bi] + w * p1) / (n[before] + w)
        p3 = (n[tri] + w * p2) / (n[context] + w)
        return np.bincount(of, np.log(p3), len(texts))


def count_grams(runs: Counter[str]) -> np.ndarray:
    """Counts by slot of the n-grams of `runs`."""
    slots = np.zeros(SLOTS, np.int64)
    items = list(runs.items())
    for i in range(0, len(items), 20_000):
        part = items[i : i + 20_000]
        (tri, _, bi, _, own), of = _grams([t for t, _ in part])
        weights = np.fromiter((n for _, n in part), np.float64, len(part))[of]
        for s in (tri, bi, own):
            slots += np.bincount(s, weights, SLOTS).astype(np.int64)
    begin = TRIGRAMS + BIGRAMS + 2
    slots[begin] += sum(runs.values())
    start = _grams([""])[0]
    slots[start[1][0]] += sum(runs.values())
    return slots


def clean_record(runs: list[str], readable: dict[str, bool]) -> bool:
    """Whether at most a tenth of the runs read as UTF-8 in another code page, as a few genuine words do."""
    return 10 * sum(not readable[r] for r in runs) <= len(runs)


def _clean_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    readable: dict[str, bool] = {}
    runs: Counter[str] = Counter()
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for text in batch["text"]:
            if text is None or text.isascii() or BROKEN.search(text):
                continue
            own = shapes(text)
            for r in own:
                if r not in readable:
                    readable[r] = not utf8_readings(r, strict=True)
            if clean_record(own, readable):
                runs.update(own)
        if len(runs) > 200_000:
            total += count_grams(runs)
            runs.clear()
        if len(readable) > 400_000:
            readable.clear()
    total += count_grams(runs)
    held = np.flatnonzero(total)
    yield pd.DataFrame({"slot": held, "n": total[held]})


def _unread_counts(texts: DataFrame, model: CharModel) -> DataFrame:
    """(slot, n) of the n-grams of those of `texts` (text, held) of which `model` reads nothing otherwise; of held ones the slots follow those of all others."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(shared.value)
        readable: dict[str, bool] = {}
        counts = (Counter(), Counter())
        totals = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for text, held, own in zip(texts, batch["held"], restorer.learn(texts), strict=True):
                if _unread(text, own, restorer, readable):
                    counts[held].update(own)
            for c, total in zip(counts, totals, strict=True):
                if len(c) > 100_000:
                    total += count_grams(c)
                    c.clear()
        for c, total in zip(counts, totals, strict=True):
            total += count_grams(c)
        slots = np.flatnonzero(totals.ravel())
        yield pd.DataFrame({"slot": slots, "n": totals.ravel()[slots]})

    return texts.mapInPandas(run, "slot long, n long")


def _unread(text: str, own: list[str], restorer: Restorer, readable: dict[str, bool]) -> bool:
    """Whether a text with the runs `own` is clean and `restorer`, which has learned it, reads none of them otherwise."""
    if BROKEN.search(text):
        return False
    if len(readable) > 400_000:
        readable.clear()
    for r in own:
        if r not in readable:
            readable[r] = not utf8_readings(r, strict=True)
    return clean_record(own, readable) and not restorer.accepted(own)


def _passed(texts: DataFrame, first: CharModel, rest: CharModel) -> DataFrame:
    """(step, n): how many of the clean ones of `texts` (text) the model `rest` reads otherwise up to a margin of step / 10, at most MOST_MARGIN."""
    shared = texts.sparkSession.sparkContext.broadcast((first, rest))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge, other = map(Restorer, shared.value)
        readable: dict[str, bool] = {}
        steps: Counter[int] = Counter()
        for batch in batches:
            texts = batch["text"].tolist()
            other.learn(texts)
            for text, own in zip(texts, judge.learn(texts), strict=True):
                if _unread(text, own, judge, readable):
                    steps[int(10 * min(other.beaten_by(own), MOST_MARGIN))] += 1
        yield pd.DataFrame(steps.items(), columns=["step", "n"], dtype="int64")

    return texts.mapInPandas(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))


def validated_margin(steps: dict[int, int]) -> float:
    """The least margin, from LEAST_MARGIN to MOST_MARGIN, beyond which at most one in 1,000 held-out texts is read otherwise."""
    allowed, margin = sum(steps.values()) // FALSE_SHARE, LEAST_MARGIN
    for step in sorted(steps, reverse=True):
        allowed -= steps[step]
        if allowed < 0:
            margin = (step + 1) / 10
            break
    return min(max(LEAST_MARGIN, margin), MOST_MARGIN)


def _summed(counts: DataFrame, folds: int = 1) -> np.ndarray:
    rows = counts.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    slots = np.zeros(folds * SLOTS, np.float64)
    slots[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return slots


def _held() -> Column:
    """Whether a different text is of the fold that is held out."""
    return F.pmod(F.col("h"), F.lit(FOLDS)) == 0


def _reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [t for t in batch["text"] if not t.isascii()]
        hashes = np.array([xxhash.xxh64_intdigest(shape(t).encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
        yield pd.DataFrame({"h": hashes.astype(np.int64), "text": [" ".join(shapes(t)) for t in texts]})


def different_texts(texts: DataFrame, held_out: bool = False) -> DataFrame:
    """(h, text) of each text with a non-ASCII character once, digits being alike; with `held_out` those of the fold that is held out.

    h is the hash of the whole text, text what is counted of it: its runs, parted by blanks.
    """
    found = texts.select("text").where("text is not null").mapInPandas(_reduced, "h long, text string")
    return (found.where(_held()) if held_out else found).distinct()


def train(documents: DataFrame, text_col: str = "text") -> CharModel:
    """The model of all clean records of `documents`, with its margin.

    It is trained twice on texts that differ: the first model leaves out misdecoded UTF-8,
    the second also what the first reads otherwise by any chain. Copies of a text count
    once, so a misdecoded one doesn't become likely by them.

    The margin is validated on the different texts of one hash fold of 16, read by the
    counts of the other folds: at most one in 1,000 of the clean ones may be read
    otherwise. It depends on the texts alone, not on batches, files or copies. A corpus without any non-ASCII text gives a
    model that accepts nothing but what is broken for certain.
    """
    different = reliable_checkpoint(different_texts(documents.select(F.col(text_col).alias("text"))))
    first = CharModel(_summed(different.select("text").mapInPandas(_clean_counts, "slot long, n long")))
    rest, held = _summed(_unread_counts(different.select("text", _held().cast("int").alias("held")), first), 2).reshape(2, SLOTS)
    # A task decides on each run once, so the few texts of the fold go to as few tasks.
    fold = different.where(_held()).select("text").coalesce(max(1, different.rdd.getNumPartitions() // FOLDS))
    steps = _passed(fold, first, CharModel(rest)).collect()
    return CharModel(rest + held, validated_margin({r["step"]: r["n"] for r in steps}))


def best_readings(runs: list[str], model: CharModel, part: bool = False) -> dict[str, tuple[str, float, str]]:
    """Of each run that can be read otherwise, its likeliest reading, the gain and the chain."""
    texts, owner, chains = [], [], []
    for i, r in enumerate(runs):
        for chain, text in readings(r, part).items():
            texts.append(text)
            owner.append(i)
            chains.append(chain)
    if not texts:
        return {}
    gain = model.log_likelihood(texts) - model.log_likelihood(runs)[owner]
    found: dict[str, tuple[str, float, str]] = {}
    for j in np.argsort(-gain, kind="stable"):
        found.setdefault(runs[owner[j]], (texts[j], float(gain[j]), chains[j]))
    return found


def _likelier(runs: list[str], model: CharModel, part: bool = False) -> dict[str, tuple[str, float, str]]:
    """`best_readings` that are likelier than the run as it stands."""
    return {r: hit for r, hit in best_readings(runs, model, part).items() if hit[1] > 0}


class Restorer:
    """Decisions by shape of run, kept while a task lasts."""

    def __init__(self, model: CharModel) -> None:
        self.model = model
        self.known: set[str] = set()
        self.hits: dict[str, list[tuple[str, tuple[str, float, str]]]] = {}

    def learn(self, texts: list[str | None]) -> list[list[str]]:
        """Decides on all runs of `texts` at once and gives the shapes of the runs of each."""
        own = [shapes(t) if t and not t.isascii() else [] for t in texts]
        if len(self.known) > 300_000:
            self.known.clear()
            self.hits.clear()
        new = list({r for runs in own for r in runs} - self.known)
        self.known.update(new)
        whole = _likelier(new, self.model)
        parts = {r: [s for s in SUBRUN.findall(r) if s != r and len(NON_ASCII.findall(s)) > 1] for r in new if r not in whole}
        by_part = _likelier(list({s for ss in parts.values() for s in ss}), self.model, True)
        self.hits |= {r: [(r, hit)] for r, hit in whole.items()}
        self.hits |= {r: found for r, ss in parts.items() if (found := [(s, by_part[s]) for s in ss if s in by_part])}
        return own

    def _gains(self, runs: list[str]) -> dict[str, dict[str, float]]:
        """By chain, the gain of every different run, or part of one, that it reads likeliest."""
        gains: dict[str, dict[str, float]] = defaultdict(dict)
        for r in self.hits.keys() & runs:
            for s, (_, gain, chain) in self.hits[r]:
                gains[chain][s] = gain
        return gains

    def _agreed(self, chain: str, runs: list[str]) -> bool:
        """Whether four fifths of the different runs that a one-byte chain changes are likeliest read by it."""
        read = {r: t for r in set(runs) if len(r) > 2 and (t := reread(r, chain)) is not None and t != r and not BROKEN.search(t)}
        return sum(any(s == r and hit[0] == t for s, hit in self.hits.get(r, ())) for r, t in read.items()) >= WHOLE_SHARE * len(read)

    def _beaten(self, chain: str, own: dict[str, float], runs: list[str]) -> float:
        """The greatest margin by which `chain`, with its gains, is accepted for a text."""
        best = sorted(own.values(), reverse=True)
        if chain.endswith(">utf-8"):
            return best[0]
        most = max([g for s, g in own.items() if len(NON_ASCII.findall(s)) >= 8] + best[1:2], default=0.0)
        together = sum(best) / WHOLE_MARGINS
        return together if together > most and len(best) >= WHOLE_RUNS and self._agreed(chain, runs) else most

    def accepted(self, runs: list[str]) -> set[str]:
        """Chains by which `runs` of one text are read beyond the margin.

        A one-byte chain changes every accented letter it meets, so it must win in two
        runs or in one with eight such letters; or, by less each, in at least four that are
        four fifths of what it changes and win by three margins together. UTF-8 checks
        itself and needs one run.
        """
        return {chain for chain, own in self._gains(runs).items() if self._beaten(chain, own, runs) >= self.model.margin}

    def beaten_by(self, runs: list[str]) -> float:
        """The greatest margin by which a chain would still be accepted for `runs` of one text; 0 if there is none."""
        return max((self._beaten(chain, own, runs) for chain, own in self._gains(runs).items()), default=0.0)

    def whole_chain(self, runs: list[str], chains: set[str]) -> str | None:
        """The one-byte chain by which most different `runs` are likeliest read, if those are four fifths of what it changes and it can read nine tenths of all.

        Runs of one or two characters say too little to be counted.
        Pages that agree in the runs accepted may differ in others, so every page is tried
        with what `chains` say the text was written in.
        """
        different = set(runs)
        best: tuple[int, int, str] | None = None
        written = sorted({c.split(">")[1] for c in chains if not c.endswith(">utf-8")})
        for chain in [f"{page}>{w}" for w in written for page in READ_AS if page not in MULTIBYTE]:
            read = {r: t for r in different if (t := reread(r, chain)) is not None and not BROKEN.search(t)}
            moved = [r for r, t in read.items() if t != r and len(r) > 2]
            agreed = sum(any(s == r and hit[0] == read[r] for s, hit in self.hits.get(r, ())) for r in moved)
            if 10 * len(read) >= 9 * len(different) and agreed > 1 and agreed >= WHOLE_SHARE * len(moved) and (best is None or (agreed, len(read)) > best[:2]):
                best = agreed, len(read), chain
        return best[2] if best else None

    def restore(self, text: str | None, runs: list[str] | None = None) -> tuple[str | None, int, int]:
        """The text with all accepted readings, how many runs were changed, and how many are beyond repair.

        `runs` are the shapes of its runs, if known. A run whose own gain is below the
        margin is read by an accepted chain if that is likelier than the run as it stands.
        Where nearly all runs of a text are read by one one-byte chain, the whole text was
        decoded so, and every run that the chain can read is taken through it.
        """
        if not text or text.isascii():
            return text, 0, 0
        runs = shapes(text) if runs is None else runs
        chains = self.accepted(runs)
        whole = self.whole_chain(runs, chains) if chains else None
        changed = 0

        def replace(m: re.Match[str]) -> str:
            nonlocal changed
            run = m[0]
            if whole and (read := reread(run, whole)) is not None and not BROKEN.search(read):
                changed += read != run
                return read
            own = shape(run)
            chosen = {s: hit[2] for s, hit in self.hits.get(own, ()) if hit[2] in chains}
            if not chosen:
                return run
            parts = [run] if own in chosen else SUBRUN.findall(run)
            taken = [reread(s, chosen[shape(s)]) if shape(s) in chosen else None for s in parts]
            changed += sum(t is not None for t in taken)
            return "".join(s if t is None else t for s, t in zip(parts, taken, strict=True))

        restored = RUN.sub(replace, text) if chains else text
        lost = sum(bool(BROKEN.search(r)) for r in RUN.findall(restored)) if BROKEN.search(restored) else 0
        return restored, changed, lost


def restore_texts(documents: DataFrame, id_col: str, text_col: str, model: CharModel) -> DataFrame:
    """id_col, restored (text), changed and lost (numbers of runs) of every affected record.

    A record is affected if a reading was accepted or a control or replacement character
    stands in it. lost counts runs that still hold one: their text can't be had. NULL,
    empty and pure ASCII texts are never affected.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(shared.value)
        for batch in batches:
            texts = batch["text"].tolist()
            rows = [(i, *restorer.restore(t, own)) for i, t, own in zip(batch["id"], texts, restorer.learn(texts), strict=True)]
            yield pd.DataFrame([r for r in rows if r[2] or r[3]], columns=["id", "restored", "changed", "lost"])

    kind = dict(documents.dtypes)[id_col]
    found = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, restored string, changed long, lost long")
    return found.withColumnRenamed("id", id_col)
