"""Noise in text from scanned pages: finding it, and repairing text into continuous paragraphs.

Lines are labelled by a hidden Markov model over layout features, fitted by Viterbi
training on a bounded sample: title, header, number (of the page), heading, figures, body,
break; a blank line is a break, or body where the paragraph runs on over it. Broken words and misread characters are told from sound ones by
the words of the whole corpus: which substitutions are misreadings is learned from rare
words that one substitution turns into a frequent one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bitset import BitSet, bit_set
from factloom.session import written

STATES = ("title", "header", "number", "heading", "figures", "body", "break")
KINDS = ("name", "name_no", "number_form", "sequence", "integer", "figures", "mark", "short", "text", "gap", "open_gap")
EDGES = ("first", "top", "middle", "bottom")
EDGE_AT = {edge: i for i, edge in enumerate(EDGES)}
KIND_AT = {kind: len(EDGES) * i for i, kind in enumerate(KINDS)}
GAP, OPEN_GAP = KIND_AT["gap"] + EDGE_AT["middle"], KIND_AT["open_gap"] + EDGE_AT["middle"]
SAMPLE_TEXTS = 4_000
MANY_LINES = 500
LONGEST_WORD = 64
IMPOSSIBLE = 1e-6
FREQUENT, RATIO, SUPPORT, PURITY = 20, 20, 3, 0.02
KNOWN_WORDS, KNOWN_WINDOWS = 50_000, 200_000

# Words for the page before its number.
PAGE_WORDS = r"page|pg|p|página|pagina|pág|seite|s|strona|str|стр|страница|หน้า|पृष्ठ|पृ|頁|ページ|第"
NUMBER_FORM = re.compile(rf"(?:(?:{PAGE_WORDS})\.?[ \xa0]*\d{{1,4}}(?:[ \xa0]*(?:/|of|de|von|z|из)[ \xa0]*\d{{1,4}})?(?:[ \xa0]*[页頁])?|\d{{1,4}}[ \xa0]*/[ \xa0]*\d{{1,4}}|\[[ \xa0]*\d{{1,4}}[ \xa0]*\]|[-–—][ \xa0]*\d{{1,4}}[ \xa0]*[-–—])", re.IGNORECASE)
INTEGER = re.compile(r"\d{1,4}")
ROMAN = re.compile(r"(?=[ivxlc])(?:x{0,3}|xl|lx{0,3}|xc|c{1,3}x{0,3})(?:ix|iv|v?i{0,3})")
FIGURE = re.compile(r"(?=\D*\d)[\d.,\s%()/–—-]+|[–—-]|n/a", re.IGNORECASE)
COMPANY_FORM = re.compile(r"\b(?:plc|inc|ltd|corp|s\.?a|gmbh|ltda)\b\.?", re.IGNORECASE)
YEARS = re.compile(r"(?:19|20)\d\d(?:[/–-]\d\d(?:\d\d)?)?")
DIGIT = re.compile(r"\d")
PAGE_NUMBER = re.compile(r"\d{1,4}|[ivxlc]{1,6}")
FIRST_NUMBER = re.compile(r"\s*(\d{1,4}|[ivxlc]{1,6})\s{2,}")
SEPARATED = re.compile(r"\s[|·•–—-]\s|\S {2,}\S|\t")
BREAK = re.compile(r"([^\W\d_][\w'’-]*|[\w-]*[^\W\d_])([-‐‑¬\xad])[ \t]*\n[ \t]*([^\W\d_][\w'’-]*)")
MARK_AT = re.compile(r"[-‐‑¬\xad][ \t]*\n")
MARKS = re.compile(r"[-‐‑¬\xad](?<=\w.)[ \t]*\n[ \t]*(?=\w)")
WORD = re.compile(r"[^\s|,;:!?…()\[\]{}\"“”„«»‘’.·/=+<>—–]+")
ASCII_GAPS = {ord(c): " " for c in "|,;:!?()[]{}\"./=+<>"}
UNSPACED = re.compile("[⺀-〿぀-ヿ㐀-鿿豈-﫿฀-๿]")
WIDE = "[\u2e80-\u9fff\uf900-\ufaff\ufe30-\ufe4f\uff00-\uffef]"
NUMBER_WORD = re.compile(r"[\d.,%°³²-]*")
INNER = "\x01"


@lru_cache(200_000)
def skeleton(text: str) -> str:
    """A form in which a text and its usual misreadings agree: lower case, look-alikes merged, without blanks and marks."""
    plain = text.isascii()
    t = text.lower() if plain else re.sub(r"[\u0300-\u036f]", "", unicodedata.normalize("NFKD", text.lower()))
    if plain:
        t = t.translate(LOOKALIKE)
    else:
        # No look-alike is turned into another, so one after the other gives the same, and faster.
        for c, alike in ALIKE:
            t = t.replace(c, alike)
    for pair, single in (("rn", "m"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("cl", "d")):
        t = t.replace(pair, single)
    return t.translate(NO_WORD) if plain else "".join(filter(str.isalnum, t))


NO_WORD = dict.fromkeys(c for c in range(128) if not chr(c).isalnum())
# Characters that stand for one another in scans.
LOOKALIKE = str.maketrans({"0": "o", "1": "l", "5": "s", "6": "b", "3": "z", "$": "s", "@": "a", "†": "t", "ſ": "f", "q": "g", "c": "e", "а": "a", "о": "o", "е": "e", "n": "n", "и": "n", "з": "z", "б": "b", "旳": "的", "午": "年", "申": "电", "置": "量", "氷": "水"})

ALIKE = tuple((chr(c), alike) for c, alike in LOOKALIKE.items() if chr(c) != alike)


@dataclass(frozen=True)
class LineModel:
    """Log probabilities of the hidden Markov model, and the skeletons of report titles."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    titles: Container[str] = ()


def prior_model(titles: Container[str] = ()) -> LineModel:
    """The model before training: likely (+), possible (.) and all but impossible ( ) pairs of state and feature."""
    weight = {"+": 8.0, ".": 1.0, " ": IMPOSSIBLE}
    # Columns: KINDS. Rows: STATES.
    by_kind = ("+          ", "++         ", "  ++.      ", "      ++.  ", "    .+.    ", "       ++ +", "         +.")
    # Columns: EDGES. Rows: STATES.
    by_edge = ("+   ", ".+ +", ".+ +", "++++", "..++", "++++", "++++")
    # Columns: following state.
    moves = ("+..+.++", " .+..++", " +...++", " ..+.++", " ...+++", " ....++", ".++++++")
    table = lambda rows: np.array([[weight[c] for c in r] for r in rows])
    kind, edge, move = table(by_kind), table(by_edge), table(moves)
    joint = kind[:, :, None] * edge[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    start = np.array([3.0, 3.0, 2.0, 3.0, 0.2, 4.0, 0.2])
    return LineModel(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(joint.reshape(len(STATES), -1)), titles)


def name_parts(line: str, company: str, titles: Container[str]) -> tuple[bool, bool, bool, str]:
    """Whether a line consists of the company's name and/or a report title, which of both, and what number is left over."""
    bare = COMPANY_FORM.sub(" ", line)
    if DIGIT.search(bare):
        bare = YEARS.sub(" ", bare)
    number = ""
    if m := FIRST_NUMBER.match(bare):
        number, bare = m[1], bare[m.end(1) :]
    elif len(parts := bare.rsplit(None, 1)) == 2 and PAGE_NUMBER.fullmatch(parts[1]) or bare[:1].isspace() and len(parts) == 1 and PAGE_NUMBER.fullmatch(parts[0]):
        number = parts[-1]
        bare = bare[: bare.rindex(number)]
    own = skeleton(bare)
    if not own:
        return False, False, False, ""
    has_company = bool(company) and company in own
    rest = own.replace(company, "", 1) if has_company else own
    has_title = bool(rest) and rest in titles
    parted = has_company and len(rest) <= 40 and SEPARATED.search(line) is not None and not line.rstrip().endswith((".", "!", "?", "।", "。"))
    return (has_company and not rest) or has_title or parted, has_company, has_title or parted, number


def features(lines: list[str], company: str, titles: Container[str], first_page: bool, page_no: int | None, offset: int | None) -> list[int]:
    """The observation of each line: kind and edge; neighbouring blank lines, of which only one must be given, have one."""
    filled = [x for x in lines if x.strip()]
    observed = _observed(filled, company, titles, first_page, page_no, offset)
    if len(filled) == len(lines):
        return observed
    at = 0
    found = []
    for line in lines:
        if line.strip():
            found.append(observed[at])
            at += 1
        else:
            above, below = filled[at - 1].rstrip() if at else "", filled[at].lstrip() if at < len(filled) else ""
            found.append(OPEN_GAP if above and below and below[0].islower() and (above[-1].isalnum() or above[-1] in ",;-‐‑¬\xad") else GAP)
    return found


def without_repeated_blanks(lines: list[str]) -> list[str]:
    """`lines` with one blank line where several follow each other, and none at either end."""
    kept: list[str] = []
    for line in lines:
        if line.strip() or kept and kept[-1].strip():
            kept.append(line)
    return kept[:-1] if kept and not kept[-1].strip() else kept


def _observed(lines: list[str], company: str, known: Container[str], first_page: bool, page_no: int | None, offset: int | None) -> list[int]:
    n = len(lines)
    company = skeleton(company.replace("_", " "))
    found = []
    for i, line in enumerate(lines):
        s = line.strip()
        near_top, near_bottom = i < 3, i >= n - 3
        kind = "text"
        if near_top or near_bottom:
            named, has_company, has_title, number = name_parts(s, company, known)
            if named:
                kind = "name_no" if number else "name"
                if has_company and has_title:
                    kind = "name_no"
            elif NUMBER_FORM.fullmatch(s):
                kind = "number_form"
            elif INTEGER.fullmatch(s) or ROMAN.fullmatch(s):
                value = int(s) if s.isdigit() else roman(s)
                kind = "sequence" if page_no is not None and (offset is not None and value - page_no == offset or not s.isdigit() and value == page_no) else "integer"
        if kind == "text":
            if s[0] == "|" or s[0] in "0123456789.,%()/–—-nN" and FIGURE.fullmatch(s):
                kind = "figures"
            elif s.startswith("#"):
                kind = "mark"
            elif len(s) <= 60 and s[-1].isalnum() and not s[0].islower():
                kind = "short"
        edge = "first" if first_page and i < 2 else "top" if near_top and i <= n // 2 else "bottom" if near_bottom else "middle"
        found.append(KIND_AT[kind] + EDGE_AT[edge])
    return found


def roman(text: str) -> int:
    """Value of a lower-case roman numeral."""
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in text]
    return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0], strict=True))


def viterbi(observed: list[int], model: LineModel) -> list[int]:
    """The likeliest states of the observed lines."""
    return _paths(tuple(observed), model) if observed else []


class _Paths:
    """Best paths by observations, kept for the model used last."""

    def __init__(self) -> None:
        self.model: LineModel | None = None
        self.known: dict[tuple[int, ...], list[int]] = {}
        self.emit: list[list[float]] = []
        self.into: list[list[float]] = []
        self.start: list[float] = []

    def _use(self, model: LineModel) -> None:
        if self.model is not model or len(self.known) > 200_000:
            self.model, self.known = model, {}
            self.emit, self.into, self.start = model.emit.T.tolist(), model.move.T.tolist(), model.start.tolist()

    def learn(self, sequences: list[list[int]], model: LineModel) -> None:
        """Finds the best paths of many observations at once, but for the few very long ones."""
        self._use(model)
        new = sorted({o for o in map(tuple, sequences) if o and o not in self.known and len(o) <= MANY_LINES}, key=len, reverse=True)
        if not new:
            return
        lengths = np.array([len(o) for o in new])
        table = np.zeros((len(new), lengths[0]), np.int64)
        for i, o in enumerate(new):
            table[i, : len(o)] = o
        emit, back = model.emit.T, np.zeros((len(new), lengths[0], len(STATES)), np.int8)
        score = model.start + emit[table[:, 0]]
        for t in range(1, lengths[0]):
            n = int(np.searchsorted(-lengths, -t, "left"))
            steps = score[:n, :, None] + model.move
            back[:n, t] = steps.argmax(axis=1)
            score[:n] = steps.max(axis=1) + emit[table[:n, t]]
        state = score.argmax(axis=1)
        paths = np.zeros(table.shape, np.int8)
        for t in range(lengths[0] - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -t, "left"))
            paths[:n, t] = state[:n]
            if t:
                state[:n] = back[np.arange(n), t, state[:n]]
        self.known.update({o: path[: len(o)].tolist() for o, path in zip(new, paths, strict=True)})

    def __call__(self, observed: tuple[int, ...], model: LineModel) -> list[int]:
        self._use(model)
        if (path := self.known.get(observed)) is None:
            path = self.known[observed] = self._best(observed)
        return path

    def _best(self, observed: tuple[int, ...]) -> list[int]:
        score = [a + b for a, b in zip(self.start, self.emit[observed[0]], strict=True)]
        back = []
        for o in observed[1:]:
            steps = [max((s + m, -i) for i, (s, m) in enumerate(zip(score, into, strict=True))) for into in self.into]
            back.append([-i for _, i in steps])
            score = [v + e for (v, _), e in zip(steps, self.emit[o], strict=True)]
        state = max(range(len(score)), key=score.__getitem__)
        path = [state]
        for from_state in reversed(back):
            state = from_state[state]
            path.append(state)
        return path[::-1]


_paths = _Paths()


def path_counts(sequences: list[tuple[list[int], float]], model: LineModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, moves and emissions along the best paths of `sequences`, each with its number."""
    start, move, emit = np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit)
    _paths.learn([o for o, _ in sequences], model)
    for o, n in sequences:
        path = viterbi(o, model)
        if path:
            start[path[0]] += n
            np.add.at(emit, (path, o), n)
            np.add.at(move, (path[:-1], path[1:]), n)
    return start, move, emit


def fit(counted: Callable[[LineModel], tuple[np.ndarray, np.ndarray, np.ndarray]], prior: LineModel, rounds: int = 3, strength: float = 50.0) -> LineModel:
    """Viterbi training: what `counted` gives along the best paths, as far as the prior holds it possible, added to it with `strength` pseudo-counts per state."""
    possible_moves = prior.move > np.log(1e-4)
    possible = prior.emit > np.log(1e-5)
    model = prior
    for _ in range(rounds):
        starts, moves, emissions = counted(model)
        start = strength * np.exp(prior.start) + starts
        move = strength * np.exp(prior.move) + moves * possible_moves
        emit = strength * np.exp(prior.emit) + emissions * possible
        model = LineModel(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(emit / emit.sum(axis=1, keepdims=True)), prior.titles)
    return model


def learn_titles(pages: DataFrame) -> BitSet:
    """Skeletons of titles: what stands under the company's name at the top of first pages of at least two reports, without years."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, company in zip(batch["text"], batch["company"], strict=True):
                lines = [s for s in (x.strip() for x in text.split("\n", 4)) if s]
                if len(lines) > 1 and skeleton(lines[0]) == skeleton(company.replace("_", " ")) and len(lines[1]) < 80:
                    rows.append((skeleton(YEARS.sub(" ", lines[1])),))
            yield pd.DataFrame(rows, columns=["title"])

    first = pages.where("page_pos = 0 and text is not null and company is not null").select("text", "company")
    return bit_set(first.mapInPandas(run, "title string").where("title != ''").groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "title")


def page_offsets(pages: DataFrame) -> DataFrame:
    """(report_id, offset): printed number minus page_num where at least two pages of a report agree, the most frequent one."""
    trimmed = F.trim(F.col("text"), F.lit(" \n\t\r"))
    line = lambda k, i: F.trim(F.element_at(F.split(F.substring_index(trimmed, "\n", k), "\n"), i))
    edge = F.explode(F.filter(F.array(line(2, 1), line(2, -1), line(-2, 1), line(-2, -1)), lambda x: x.rlike(r"^\d{1,4}$")))
    found = pages.where("page_num is not null and report_id is not null").select("report_id", "page_num", edge.alias("n"))
    counts = found.groupBy("report_id", (F.col("n").cast("int") - F.col("page_num")).alias("offset")).agg(F.countDistinct("page_num").alias("k")).where("k >= 2")
    return counts.groupBy("report_id").agg(F.max(F.struct("k", (-F.col("offset")).alias("o"))).alias("m")).select("report_id", (-F.col("m.o")).alias("offset"))


def texts_of(pages: DataFrame, snippets: DataFrame) -> DataFrame:
    """Pages and snippets in one form: src, row_id, company, first_page, page_no, report_id, text; NULL and empty texts are left out."""
    a = pages.select(F.lit("report_pages").alias("src"), F.col("page_id").alias("row_id"), "company", F.coalesce(F.col("page_pos") == 0, F.lit(False)).alias("first_page"), F.col("page_num").cast("int").alias("page_no"), "report_id", "text")
    b = snippets.select(F.lit("extractions").alias("src"), F.col("extraction_id").alias("row_id"), "company", F.lit(False).alias("first_page"), F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("long").alias("report_id"), F.col("source_snippet").alias("text"))
    return a.unionAll(b).where("text is not null and text != ''")


def numbered(texts: DataFrame, offsets: DataFrame) -> DataFrame:
    """`texts` with the `offset` of their report; snippets, which have none, aren't moved for it."""
    pages = texts.where("src = 'report_pages'").join(offsets, "report_id", "left")
    rest = texts.where("src != 'report_pages'").withColumn("offset", F.lit(None).cast("int"))
    return pages.unionByName(rest).select("src", "row_id", "company", "first_page", "page_no", F.col("offset").cast("int").alias("offset"), "text")


def observe(text: str, company: str | None, first_page: bool, page_no: int | None, offset: int | None, titles: Container[str]) -> tuple[list[str], list[int]]:
    """The lines of a text, of neighbouring blank ones one, and what is observed of each."""
    kept = without_repeated_blanks(text.split("\n"))
    return kept, features(kept, re.sub(r"[-_ ]+", " ", company or "").strip(), titles, first_page, page_no, offset)


def label_observed(texts: list[str], observed: list[tuple[list[str], list[int]]], model: LineModel) -> list[list[tuple[str, str]]]:
    """(label, line) of every line of each text of which `observe` is given; blank lines are labelled break, or body where a paragraph runs on."""
    _paths.learn([o for _, o in observed], model)
    found = []
    for text, (kept, o) in zip(texts, observed, strict=True):
        lines = text.split("\n")
        states = [STATES[k] for k in viterbi(o, model)]
        if len(kept) == len(lines):
            found.append(list(zip(states, lines, strict=True)))
            continue
        labelled, at = [], 0
        for line in lines:
            if line.strip():
                # A kept blank line before it was passed by the blank ones above.
                at += not kept[at].strip()
                labelled.append((states[at], line))
                at += 1
            else:
                labelled.append((states[at] if 0 < at < len(kept) and not kept[at].strip() else "break", line))
        found.append(labelled)
    return found


def label_lines(text: str, company: str | None, first_page: bool, page_no: int | None, offset: int | None, model: LineModel) -> list[tuple[str, str]]:
    """`label_observed` of one text."""
    return label_observed([text], [observe(text, company, first_page, page_no, offset, model.titles)], model)[0]


def noise_of_lines(labelled: list[tuple[str, str]], company: str | None, titles: Container[str]) -> set[str]:
    """header and page_number, if lines so labelled say so."""
    kinds = set()
    own = skeleton(re.sub(r"[-_ ]+", " ", company or "").strip())
    for label, line in labelled:
        if label == "header":
            kinds.add("header")
            if name_parts(line.strip(), own, titles)[3]:
                kinds.add("page_number")
        elif label == "number":
            kinds.add("page_number")
    return kinds


def without_broken(text: str) -> str:
    """`text` without the words that a mark at the end of a line breaks, so that these don't speak for themselves."""
    kept, done = [], 0
    for m in MARKS.finditer(text):
        a, b = m.start(), m.end()
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        kept.append(text[done:a])
        done = max(done, b)
    return "".join([*kept, text[done:]]) if done else text


def words_of(text: str) -> list[str]:
    """Lower-case words of a text, broken ones left out."""
    return words_in(without_broken(text) if "\n" in text else text)


def words_in(text: str) -> list[str]:
    """Lower-case words of a text as it stands."""
    return text.lower().translate(ASCII_GAPS).split() if text.isascii() else WORD.findall(text.lower())


def windows_of(text: str) -> list[str]:
    """Every character of an unspaced script with two characters on either side; digits are alike and blanks don't count."""
    if text.isascii() or not UNSPACED.search(text):
        return []
    t = re.sub(r"\d+", "0", re.sub(r"\s+", "", text))
    return [t[i - 2 : i + 3] for i in range(2, len(t) - 2) if UNSPACED.match(t[i])]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: Counter[str] = Counter()
    windows: Counter[str] = Counter()

    def flush() -> pd.DataFrame:
        rows = [(w, False, n) for w, n in words.items() if 2 <= len(w) <= LONGEST_WORD and not UNSPACED.search(w) and not NUMBER_WORD.fullmatch(w)] + [(w, True, n) for w, n in windows.items()]
        words.clear()
        windows.clear()
        return pd.DataFrame(rows, columns=["word", "unspaced", "n"])

    for batch in batches:
        for text in batch["text"]:
            words.update(words_of(text))
            windows.update(windows_of(text))
        if len(words) + len(windows) > 400_000:
            yield flush()
    yield flush()


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, unspaced, n) of all words, and of all windows of unspaced scripts; a text counts once however many rows hold it."""
    return texts.select("text").distinct().mapInPandas(_counted, "word string, unspaced boolean, n long").groupBy("word", "unspaced").agg(F.sum("n").alias("n"))


def _patterns(words: DataFrame) -> DataFrame:
    """Each word once for every one or two neighbouring characters taken out; of a window only its middle one."""
    size = F.length("word")
    taken = lambda i, k: F.struct(F.concat(F.substring("word", F.lit(1), i), F.lit(INNER), F.substring("word", i + k + 1, size)).alias("pattern"), F.substring("word", i + 1, F.lit(k)).alias("part"))
    every = F.concat(F.transform(F.sequence(F.lit(0), size - 1), lambda i: taken(i, 1)), F.transform(F.sequence(F.lit(0), size - 2), lambda i: taken(i, 2)))
    middle = F.array(F.struct(F.concat(F.substring("word", 1, 2), F.lit(INNER), F.substring("word", 4, 2)).alias("pattern"), F.substring("word", 3, 1).alias("part")))
    cut = words.select("word", "unspaced", "n", F.explode(F.when(F.col("unspaced"), middle).otherwise(every)).alias("p"))
    return cut.select("word", "unspaced", "n", "p.pattern", "p.part").where(F.length("pattern") >= 3)


def misreadings(words: DataFrame) -> DataFrame:
    """(word, unspaced, meant): misread words and what they mean.

    A word is misread if a learned substitution of one or two characters turns it into one
    at least 20 times as frequent, or one of a sign or digit between letters into one that
    is at least as frequent and seen twice. A substitution is learned if at least three
    rare words (two windows, or one word if it replaces a single sign or digit) are turned
    by it into such frequent ones, and a fiftieth of all words that hold what it replaces.
    Raised and lowered digits are notation, and characters merely lost or added no
    misreading. Of several meanings the one by the best supported substitution counts,
    then the most frequent.
    """
    least = F.when(F.col("unspaced"), F.lit(2)).when((F.length("part") == 1) & F.col("part").rlike(r"[^\p{L}]"), F.lit(1)).otherwise(F.lit(SUPPORT))
    frequent = _patterns(words.where(F.col("n") >= FREQUENT)).where("unspaced or length(word) > 2").select("pattern", "unspaced", F.col("word").alias("meant"), F.col("n").alias("m"), F.col("part").alias("true"))
    cut = _patterns(words)
    letters = r"^[^\s\-'‐‑¬\x{ad}]+$"
    sound = F.col("part").rlike(letters) & ~F.col("part").rlike(r"\p{No}") & F.col("true").rlike(letters) & F.col("true").rlike(r"\p{L}") & ~F.contains("part", "true") & ~F.contains("true", "part")
    hits = cut.join(frequent.hint("merge"), ["pattern", "unspaced"]).where((F.col("m") >= RATIO * F.col("n")) & sound).select("word", "unspaced", "n", "meant", "m", "part", "true").distinct()
    hits = written(hits)
    support = hits.groupBy("unspaced", "part", "true").agg(F.countDistinct("word").alias("k"))
    held = cut.join(support.select("unspaced", "part").distinct(), ["unspaced", "part"], "left_semi").groupBy("unspaced", "part").agg(F.countDistinct("word").alias("held"))
    pure = F.col("unspaced") | F.col("part").rlike(r"[^\p{L}]") | (F.col("k") >= PURITY * F.col("held"))
    learned = written(support.join(held, ["unspaced", "part"]).where((F.col("k") >= least) & pure).select("unspaced", "part", "true", "k"))
    signs = learned.where((F.col("k") >= SUPPORT) & ~F.col("unspaced") & (F.length("part") == 1) & F.col("part").rlike(r"[^\p{L}]")).select("part", "true", "k")
    held_signs = words.where(~F.col("unspaced") & F.col("word").rlike(r"\p{L}[^\p{L}]\p{L}"))
    mended = _patterns(held_signs).where(F.col("pattern").rlike(r"\p{L}\x01\p{L}")).join(signs, "part").select("word", "unspaced", "n", F.replace("pattern", F.lit(INNER), F.col("true")).alias("meant"), "k")
    mended = mended.join(words.where(~F.col("unspaced") & (F.col("n") > 1)).select(F.col("word").alias("meant"), F.col("n").alias("m")).hint("shuffle_hash"), "meant").where("m >= n").select("word", "unspaced", "k", "m", "meant")
    every = hits.join(learned, ["unspaced", "part", "true"]).select("word", "unspaced", "k", "m", "meant").unionByName(mended)
    best = every.groupBy("word", "unspaced").agg(F.max(F.struct("k", "m", "meant")).alias("b"))
    return best.select("word", "unspaced", F.col("b.meant").alias("meant"))


def broken_forms(text: str) -> set[tuple[str, str]]:
    """`breaks` of every word of `text` that a mark at the end of a line breaks."""
    found = set()
    for mark in MARK_AT.finditer(text):
        at = mark.start()
        while at and (text[at - 1].isalnum() or text[at - 1] in "_'’-"):
            at -= 1
        while at < mark.start() and text[at] in "'’-":
            at += 1
        if m := BREAK.match(text, at):
            found.add(breaks(m))
    return found


def evidence(texts: DataFrame, model: LineModel, known: tuple[frozenset[str], frozenset[str]]) -> DataFrame:
    """(src, row_id, what, a, b): lines found, breaks (both parts, and whether the mark may be of the word) and words that aren't `known`."""
    shared = texts.sparkSession.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines_model, (words, windows) = shared.value
        titles = lines_model.titles
        for batch in batches:
            rows: list[tuple] = []
            several = [r for r in batch.itertuples(index=False, name=None) if "\n" in r[6]]
            observed = [observe(text, company, first, None if pd.isna(no) else int(no), None if pd.isna(offset) else int(offset), titles) for _, _, company, first, no, offset, text in several]
            for (src, i, company, *_), labelled in zip(several, label_observed([r[6] for r in several], observed, lines_model), strict=True):
                rows += [(src, i, k, None, None) for k in noise_of_lines(labelled, company, titles)]
            for src, i, text in zip(batch["src"], batch["row_id"], batch["text"], strict=True):
                if "\n" in text:
                    rows += [(src, i, "break", a, b) for a, b in broken_forms(text)]
                    text = MARKS.sub("", text)
                for w in set(words_in(text)) - words:
                    if not w.isdigit() and len(w) <= LONGEST_WORD and not NUMBER_WORD.fullmatch(w):
                        rows.append((src, i, "word", w, None))
                if not text.isascii():
                    rows += [(src, i, "window", w, None) for w in set(windows_of(text)) - windows]
            yield pd.DataFrame(rows, columns=["src", "row_id", "what", "a", "b"])

    return texts.select("src", "row_id", "company", "first_page", "page_no", "offset", "text").mapInPandas(run, "src string, row_id long, what string, a string, b string")


def breaks(m: re.Match[str]) -> tuple[str, str]:
    """Of a broken word its parts, U+0001 between them, and "-" if the mark may be part of a word, else ""."""
    return m[1].lower() + INNER + re.sub(r"['’].*", "", m[3].lower()), "-" if m[2] in "-‑" else ""


def learn(pages: DataFrame, texts: DataFrame, offsets: DataFrame) -> LineModel:
    """The line model, fitted on at most 4,000 texts of several lines, those with the least hashes.

    Observations and the counts of each round of training are made where the texts are;
    only counts, as many as the model has numbers, come to the driver.
    """
    titles = learn_titles(pages)
    prior = prior_model(titles)
    chosen = texts.where("instr(text, '\n') > 0").select("src", "row_id").orderBy(F.xxhash64("src", "row_id"), "src", "row_id").limit(SAMPLE_TEXTS).distinct()
    sample = numbered(texts.join(F.broadcast(chosen), ["src", "row_id"], "left_semi"), offsets)
    shared = texts.sparkSession.sparkContext.broadcast(titles)

    def observations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for company, first, no, offset, text in batch.itertuples(index=False, name=None):
                rows.append((observe(text, company, first, None if pd.isna(no) else int(no), None if pd.isna(offset) else int(offset), shared.value)[1],))
            yield pd.DataFrame(rows, columns=["o"])

    sequences = written(sample.select("company", "first_page", "page_no", "offset", "text").mapInPandas(observations, "o array<int>").groupBy("o").agg(F.count(F.lit(1)).alias("n")))

    def counted(model: LineModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                own = path_counts([(list(o), n) for o, n in zip(batch["o"], batch["n"], strict=True)], model)
                total = own if total is None else tuple(a + b for a, b in zip(total, own, strict=True))
            for table, values in enumerate(total or ()):
                yield pd.DataFrame({"t": table, "i": np.arange(values.size), "v": values.ravel()})

        start, move, emit = np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit)
        for r in sequences.mapInPandas(run, "t int, i int, v double").groupBy("t", "i").agg(F.sum("v").alias("v")).collect():
            (start, move, emit)[r["t"]].ravel()[r["i"]] = r["v"]
        return start, move, emit

    return fit(counted, prior)


@dataclass(frozen=True)
class Findings:
    """What a pass over all texts found: the model, texts, words with counts, misread words, and the evidence by row."""

    model: LineModel
    texts: DataFrame
    words: DataFrame
    wrong: DataFrame
    found: DataFrame

    def broken(self) -> DataFrame:
        """(src, row_id, a, b) of words broken by a mark that isn't part of them."""
        return broken_words(self.found, self.words)

    def misread(self) -> DataFrame:
        """(src, row_id, word, meant, unspaced) of misread words and windows."""
        asked = self.found.where("what in ('word', 'window')").select("src", "row_id", F.col("a").alias("word"), (F.col("what") == "window").alias("unspaced"))
        return asked.join(self.wrong.hint("shuffle_hash"), ["word", "unspaced"])


def examine(pages: DataFrame, snippets: DataFrame) -> Findings:
    """Learns from all pages and snippets and gathers the evidence in them."""
    texts, offsets = texts_of(pages, snippets), written(page_offsets(pages))
    model = learn(pages, texts, offsets)
    words = written(vocabulary(texts))
    wrong = written(misreadings(words))
    sound = words.join(wrong.hint("shuffle_hash"), ["word", "unspaced"], "left_anti").where(F.col("n") >= FREQUENT)
    top = lambda unspaced, most: frozenset(r["word"] for r in sound.where(F.col("unspaced") == unspaced).orderBy(F.desc("n"), "word").limit(most).select("word").collect())
    known = (top(False, KNOWN_WORDS), top(True, KNOWN_WINDOWS))
    placed = numbered(texts, offsets)
    return Findings(model, placed, words, wrong, written(evidence(placed, model, known)))


def find_noise(pages: DataFrame, snippets: DataFrame) -> DataFrame:
    """(src, row_id, kind) of all noise in pages and snippets; kind is hyphen, character, header or page_number.

    NULL and empty texts have none. Ids needn't be unique; equal rows give one result.
    """
    own = examine(pages, snippets)
    lines = own.found.where("what in ('header', 'page_number')").select("src", "row_id", F.col("what").alias("kind"))
    characters = own.misread().select("src", "row_id", F.lit("character").alias("kind"))
    return lines.unionAll(characters).unionAll(own.broken().select("src", "row_id", F.lit("hyphen").alias("kind"))).distinct()


def repaired_text(labelled: list[tuple[str, str]], broken: set[str], meant: dict[str, str], windows: dict[str, str]) -> str:
    """Paragraphs of the text: running lines and page numbers left out, lines joined, broken words mended, misread ones replaced."""
    blocks: list[list[str]] = [[]]
    last = ""
    for label, line in labelled:
        if label in ("header", "number") or not line.strip() and label != "break":
            continue
        if label == "break" or label in ("title", "heading", "figures") or last in ("title", "heading", "figures") and label != last:
            blocks.append([])
        if label != "break":
            blocks[-1].append(line.strip())
        last = label

    def mended(m: re.Match[str]) -> str:
        return m[1] + ("" if breaks(m)[0] in broken else m[2]) + m[3]

    def reread(m: re.Match[str]) -> str:
        true = meant.get(m[0].lower())
        if true is None:
            return m[0]
        return true.upper() if m[0].isupper() and len(m[0]) > 1 else true.capitalize() if m[0][0].isupper() else true

    paragraphs = []
    for lines in blocks:
        text = BREAK.sub(mended, "\n".join(lines))
        text = re.sub(f"(?<={WIDE})\n(?={WIDE})", "", text).replace("\n", " ")
        text = WORD.sub(reread, text) if meant else text
        for wrong, true in windows.items():
            text = re.sub(re.escape(wrong).replace("0", r"(\d+)"), lambda m, w=wrong, t=true: m[0].replace(w[2], t[2]), text)
        if text.strip():
            paragraphs.append(text.strip())
    return "\n\n".join(paragraphs)


def repair(pages: DataFrame, snippets: DataFrame) -> DataFrame:
    """(src, row_id, text): every page and snippet that has text as continuous paragraphs."""
    own = examine(pages, snippets)
    fixes = own.misread().select("src", "row_id", F.struct(F.when(F.col("unspaced"), F.lit("window")).otherwise(F.lit("word")).alias("what"), F.col("word").alias("a"), F.col("meant").alias("b")).alias("f"))
    mends = own.broken().select("src", "row_id", F.struct(F.lit("break").alias("what"), F.col("a"), F.lit(None).cast("string").alias("b")).alias("f"))
    per_row = fixes.unionAll(mends).groupBy("src", "row_id").agg(F.collect_set("f").alias("fixes"))
    joined = own.texts.join(per_row, ["src", "row_id"], "left")
    shared = own.texts.sparkSession.sparkContext.broadcast(own.model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            rows = []
            given = list(batch.itertuples(index=False, name=None))
            observed = [observe(text, company, first, None if pd.isna(no) else int(no), None if pd.isna(offset) else int(offset), model.titles) for _, _, company, first, no, offset, text, _ in given]
            for (src, i, *_, own_fixes), labelled in zip(given, label_observed([r[6] for r in given], observed, model), strict=True):
                by: dict[str, dict[str, str]] = {"word": {}, "window": {}, "break": {}}
                for f in own_fixes if own_fixes is not None else []:
                    by[f["what"]][f["a"]] = f["b"]
                rows.append((src, i, repaired_text(labelled, set(by["break"]), by["word"], by["window"])))
            yield pd.DataFrame(rows, columns=["src", "row_id", "text"])

    return joined.select("src", "row_id", "company", "first_page", "page_no", "offset", "text", "fixes").mapInPandas(run, "src string, row_id long, text string")


def broken_words(found: DataFrame, words: DataFrame) -> DataFrame:
    """The breaks of `found` whose mark isn't part of the word.

    The joined form must be at least as frequent as the hyphenated one, both counted where
    no line ends. Where neither is seen, the mark is taken for part of a compound if both
    its parts are words seen at least 20 times.
    """
    # Hints keep tables that grow with the corpus from being sent to every task.
    counts = words.where("not unspaced").select("word", "n").hint("shuffle_hash")
    marks = found.where("what = 'break'").select("src", "row_id", "a", "b")
    forms = marks.select("a", "b").distinct().withColumns(
        {"joined": F.replace("a", F.lit(INNER), F.lit("")), "hyphenated": F.replace("a", F.lit(INNER), F.lit("-")), "before": F.substring_index("a", INNER, 1), "after": F.substring_index("a", INNER, -1)}
    )
    asked = forms.select("a", "b", F.explode(F.array(*[F.struct(F.lit(c).alias("form"), F.col(c).alias("word")) for c in ("joined", "hyphenated", "before", "after")])).alias("f")).select("a", "b", "f.*")
    seen = asked.join(counts, "word", "left").groupBy("a", "b").agg(*[F.coalesce(F.max(F.when(F.col("form") == c, F.col("n"))), F.lit(0)).alias(c) for c in ("joined", "hyphenated", "before", "after")])
    unseen = (F.col("joined") == 0) & (F.col("hyphenated") == 0)
    compound = F.when(unseen, (F.col("before") >= FREQUENT) & (F.col("after") >= FREQUENT)).otherwise(F.col("hyphenated") > F.col("joined"))
    return marks.join(seen.where((F.col("b") == "") | ~compound).select("a", "b"), ["a", "b"], "left_semi")
