"""Ends of sentences in many languages and scripts.

A pushdown automaton runs over the terminators, quotation marks, brackets, list markers
and blank lines of a text. What stands in a matched pair, or in one still open where the
text breaks off, never ends the sentence around it; a pair can't reach beyond its
paragraph or list item. List levels are kept on a stack of their own, so the mark of an
item, which continues or begins a level, is told from a number that ends a sentence. A
full stop is looked up backwards in a trie of abbreviations; what follows decides the
rest. Thai, which has no terminators, is cut at spaces before beginnings, and ends where
endings stand, that are learned from the paragraphs of the whole corpus; in texts of
several scripts each stretch of lines is handled by its own script.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bitset import BitSet, bit_set
from factloom.session import written

# Abbreviations by what their full stop means.
# Never the end of a sentence.
NEVER = """
dr prof mr mrs ms messrs st ft mt dipl ing cf viz approx excl incl avg est e.g i.e vs u.s u.k
vgl bzw ca z.b d.h i.d.r tsd mio mrd sog ggf inkl zzgl
sr sra srta dra dña aprox p.ej ee ej env c.-à-d mme mlle
por zob m.in tj ok tys mln mld mgr inż tzn np
т.е ср ок тыс млн млрд напр им ул
मे डॉ सं पृ लि श्री
"""
# Before a number, a letter or another abbreviation.
REFERENCE = """
no nos nr fig figs sec sect art arts para paras p pp pg vol ch chap eq app tab tabs ref
abs lit kap abb anh s al par párr pág págs cap núm núms n fr v ust rozdz zał rys poz
ст п пп гл рис табл стр разд прил
"""
# May be the end of a sentence, if its next word can begin one.
PERHAPS = "etc a.m p.m p.a u.a usw itd itp т.д т.п и.др uu"
# The same, but at the end of a text the sentence breaks off.
COMPANY = "inc ltd co corp bros ltda s.a s.l s.a.s s.r.l"
# The same, but not before a number.
MONTH = "jan feb mar apr jun jul aug sep sept oct nov dec янв фев февр мар апр авг сент окт нояб дек"
# The only abbreviations that stay one in capitals.
UPPER = frozenset(("EE", "UU", "MM"))
# Letters after these words are names of annexes.
ANNEX = frozenset("annex annexes appendix anhang anexo anexos annexe załącznik zał приложение прил schedule exhibit".split())
# Months a German day stands before.
GERMAN_MONTH = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")

ITEM = r"(?<![^\n])[ \t]*[(（]?(?:\d{1,3}|[A-Za-z]|[ivxlc]{2,6}|[IVXLC]{2,6})[.)）](?=[ \t])|(?<![^\n])[ \t]*[•▪◦*-](?=[ \t])"
TOKEN = re.compile(ITEM + r"|[.!?…]+|[。！？｡।॥]+|[\"“”„‟«»「」『』()（）\[\]［］]|\n[ \t\r]*\n")
CLOSERS = re.compile(r"[   ]?[»]|[\"”“’'」』)\]）］]")
PAIRS = {"(": ")", "（": "）", "[": "]", "［": "］", "「": "」", "『": "』", "«": "»"}
OPENING = "\"“„«「『([（［¿¡‘"
SPACE = re.compile(r"[\s​  ]*")
THAI = re.compile("[฀-๿]")
GAP = re.compile(r"[ \xa0\n]+")
WORDS = re.compile(r"[^\W\d_฀-๿]{2,}")
BEGINNING, ENDING = 5, 4
EDGE_SUPPORT, EDGE_SHARE = 3, 200
ROMAN = {c: n for c, n in zip("ivxlc", (1, 5, 10, 50, 100), strict=True)}


def _trie() -> dict:
    """Reversed abbreviations, each with and without blanks after inner full stops; under "" what its full stop means."""
    root: dict = {}
    for meaning, words in (("never", NEVER), ("reference", REFERENCE), ("perhaps", PERHAPS), ("company", COMPANY), ("month", MONTH)):
        for word in words.split():
            for spelled in {word, word.replace(".", ". ")}:
                node = root
                for c in reversed(spelled):
                    node = node.setdefault(c, {})
                node[""] = meaning
    return root


TRIE = _trie()


def abbreviation(text: str, stop: int) -> tuple[str, int] | None:
    """What the full stop at `stop` means after the longest abbreviation before it, and where that begins."""
    node, found, i = TRIE, None, stop - 1
    while i >= 0:
        c = text[i].lower()
        node = node.get(" " if c.isspace() else c)
        if node is None:
            break
        if "" in node and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in "-’'" or text[i - 1] == "." and re.search(r"(?:^|[^\w])[^\W\d_]\.$", text[max(0, i - 3) : i]))):
            found = node[""], i
        i -= 1
    if found and (word := text[found[1] : stop]).isupper() and len(word) > 1 and "." not in word and word not in UPPER:
        return None
    return found


def _roman(text: str) -> int:
    values = [ROMAN[c] for c in text]
    return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0], strict=True))


def _readings(mark: str) -> list[tuple[str, int]]:
    """(kind of numbering, place in it) a list mark may mean, the likelier first."""
    inner = mark.strip(" \t().（）")
    form = mark.strip()[0] in "(（", mark.strip()[-1]
    case = "upper" if inner.isupper() else "lower"
    if not inner.isalnum():
        return [(f"{inner}", 0)]
    if inner.isdigit():
        return [(f"digits{form}", int(inner))]
    letter = [(f"{case} letters{form}", ord(inner.lower()) - 96)] if len(inner) == 1 else []
    numeral = [(f"{case} numerals{form}", _roman(inner.lower()))] if set(inner.lower()) <= ROMAN.keys() else []
    return numeral + letter if inner.lower() == "i" else letter + numeral


class _Levels:
    """The stack of list levels: kind of numbering and the place reached in it."""

    def __init__(self, text: str) -> None:
        self.text, self.stack, self.items = text, [], None

    def _followed(self, kind: str, place: int, at: int) -> bool:
        """Whether a mark that continues the level stands further on."""
        if self.items is None:
            self.items = {}
            for m in re.finditer(ITEM, self.text):
                for own in _readings(m[0]):
                    self.items[own] = m.start()
        return self.items.get((kind, place + 1), -1) > at

    def enter(self, mark: str, at: int) -> bool:
        """Whether the mark at a line's start is that of an item, whose level is then on top of the stack.

        It is if it continues a level, begins one (1, a, A, i) after a line that is
        complete or where its successor follows, or stands where a text or paragraph begins.
        """
        means = _readings(mark)
        for kind, place in means:
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth][0] == kind and (place == self.stack[depth][1] + 1 or not place):
                    del self.stack[depth:]
                    self.stack.append((kind, place))
                    return True
        above = self.text[:at].rstrip(" \t\r") if at < 80 else self.text[at - 80 : at].rstrip(" \t\r")
        opens = above in ("", "\n") or above.endswith("\n\n") or re.search(r"\n[ \t\r]*\n$", above) is not None
        line = above.rstrip()
        complete = line[-1:] in tuple(".:;!?…。：；！？") and not (line[-1] == "." and abbreviation(line, len(line) - 1))
        for kind, place in means:
            if opens or place < 2 and (complete or place and self._followed(kind, place, at)):
                self.stack.append((kind, place))
                return True
        return False


def matched(text: str, tokens: list[re.Match[str]]) -> tuple[dict[int, int], set[int]]:
    """Of every opening mark that counts, the place of its closing mark, the end of the text if it is still open there; and the places of list marks.

    Marks left open at the end of a paragraph before the last, or of a list item, don't count.
    """
    pairs: dict[int, int] = {}
    items: set[int] = set()
    stack: list[tuple[str, int]] = []
    levels = _Levels(text)
    for m in tokens:
        c, i = m[0], m.start()
        if c[0] == "\n":
            stack.clear()
            continue
        if len(c) > 1 and c[-1] in ".)）" and c.strip(" \t().（）").isalnum() or c[-1] in "•▪◦*-":
            if levels.enter(c, i):
                items |= {i, m.end() - len(c.lstrip(" \t"))}
                stack.clear()
            continue
        if len(c) > 1 or c in ".!?…。！？｡।॥":
            continue
        opens = c in PAIRS or c in "„‟"
        if c in "“\"":
            awaited = any(o == c or c == "“" and o in "„‟" for o, _ in stack)
            before = text[i - 1] if i else " "
            beyond = text[i + 1] if i + 1 < len(text) else " "
            opens = not awaited and (beyond.isalnum() or beyond in OPENING) and not (before.isalnum() and before.isascii())
        if opens:
            stack.append((c, i))
            continue
        for k in range(len(stack) - 1, -1, -1):
            o = stack[k][0]
            if PAIRS.get(o) == c or o == c == '"' or c == "”" and o in "“„‟" or c == "“" and o in "„‟" or c == '"' and o in "„“":
                pairs[stack[k][1]] = i
                del stack[k:]
                break
    pairs |= {i: len(text) for _, i in stack}
    return pairs, items


def _begins(text: str, at: int) -> bool:
    """Whether a sentence may begin at `at`, where no blank stands."""
    c = text[at]
    if c.islower():
        return at + 1 < len(text) and text[at + 1].isupper()
    return c.isalnum() or c in OPENING or c in "#|•*" or not (c.isascii() or c in "—–…·，、；：。”’»」』）％‰°")


def _word_before(text: str, at: int) -> str:
    m = re.search(r"([^\W\d_]+)\.?[\s]*$", text[max(0, at - 24) : at])
    return m[1].lower() if m else ""


def _stop_ends(text: str, i: int, after: int, following: int) -> bool:
    """Whether the single full stop at `i` can end a sentence; `following` is the next place without blank."""
    at_end = following >= len(text)
    nxt = "" if at_end else text[following]
    before = text[i - 1] if i else " "
    if before.isspace() or "ऀ" <= before <= "ॿ":
        return False
    if after == following and not at_end:
        if before.isdigit():
            return nxt.isupper() and (text[following + 1 : following + 2].islower() or text[following + 1 : following + 2] in ("’", "'"))
        return before.islower() and i > 1 and text[i - 2].isalpha() and nxt.isupper() and text[following + 1 : following + 2].islower() or nxt in "«“„" and not before.isspace()
    if before.isdigit():
        number = re.search(r"[\d.,]*$", text[max(0, i - 12) : i])[0]
        begin = i - len(number)
        if len(number) <= 2 and (nxt.isdigit() or GERMAN_MONTH.match(text, following)):
            return False
        opening = text[max(0, begin - 8) : begin].rstrip(" ")
        return not (len(number) <= 3 and (opening == "" or opening.endswith("\n\n")) and not at_end)
    if hit := abbreviation(text, i):
        meaning, start = hit
        if meaning == "never":
            return False
        if meaning == "reference":
            if at_end or nxt.isdigit() or re.match(r"[^\W\d_](?![^\W\d_])|[IVXLC]+\b|[^\W\d_]{1,5}\.", text[following : following + 7]):
                return False
            return len(text[start:i]) > 1
        if meaning == "month":
            return not at_end and not nxt.isdigit()
        if meaning == "company":
            return not at_end
        return not (at_end and text[start:i].lower() == "p.m" and "a.m." in text[max(0, i - 16) : i])
    word = re.search(r"[^\W\d_]+$", text[max(0, i - 3) : i])
    if word and len(word[0]) == 1 and (i < 2 or text[i - 2].isspace() or text[i - 2] in "([.,;“\"„«"):
        if word[0] in "гr":
            return re.search(r"\d{4}\s*$", text[max(0, i - 8) : i - 1]) is not None
        return word[0].isupper() and _word_before(text, i - 1) in ANNEX or word[0] in "³²"
    return True


def sentence_ends(text: str | None) -> list[int]:
    """Numbers of characters up to and including the last one of each sentence, in order.

    NULL, empty and blank texts have none, and neither has a sentence that breaks off at
    the end of the text. Headings, table lines, lone figures and running lines have no
    terminator and so no end. Thai isn't handled here.
    """
    if not text:
        return []
    tokens = list(TOKEN.finditer(text))
    pairs, items = matched(text, tokens)
    closes = {j: i for i, j in pairs.items()}
    ends: list[int] = []
    depth_until = -1
    last = 0
    size = len(text)
    for m in tokens:
        c, i = m[0], m.start()
        if c[0] == "\n" or i in items:
            continue
        if len(c) > 1 and c[0] not in ".!?…。！？｡।॥":
            # A mark of no list: what it ends with is a full stop or a bracket like any other.
            i, c = m.end() - 1, c[-1]
        if i in pairs and pairs[i] > depth_until:
            depth_until = pairs[i]
            continue
        if c[0] not in ".!?…。！？｡।॥":
            if i not in closes or i != depth_until:
                continue
            depth_until = -1
            inner = text[max(0, i - 8) : i].rstrip()[-1:]
            if inner not in ".!?…。！？｡।॥" or not inner:
                continue
            opened = closes[i]
            after = i + 1
            following = SPACE.match(text, after).end()
            intro = text[max(0, opened - 3) : opened].rstrip()[-1:]
            if following >= size:
                good = not (inner == "." and abbreviation(text, text.rfind(".", 0, i)))
            elif "\n" in text[after:following] and "\n\n" in re.sub(r"[ \t\r]", "", text[after:following]):
                good = True
            else:
                nxt = text[following]
                cased = nxt.isupper() or nxt.islower()
                if intro and intro in ":：，,、" or cased and intro and not THAI.match(intro):
                    good = _begins(text, following) and nxt not in "とと"
                else:
                    good = cased and nxt.isupper() and opened > last and inner not in "。！？" or nxt in "“„\"«「" and opened <= last
            if good:
                ends.append(after)
                last = SPACE.match(text, after).end()
            continue
        if i < depth_until:
            continue
        after = m.end()
        while after < size and (q := CLOSERS.match(text, after)):
            if q[0] in "“\"" and after in pairs:
                break
            after = q.end()
        following = SPACE.match(text, after).end()
        if c[0] in "。！？｡।॥":
            good = following >= size or text[following] not in "，、；：—–"
        else:
            if following < size and following not in items and not _begins(text, following):
                good = "\n\n" in text[after:following] and c != "."
            elif c == ".":
                good = _stop_ends(text, i, after, following)
            elif after == following and following < size:
                good = not text[following].isdigit() and not text[following].isascii() or text[following].isupper()
            else:
                good = len(c) < 3 or c[0] != "." or following < size
        if good:
            ends.append(after)
            last = following
    return ends


@dataclass(frozen=True)
class ThaiModel:
    """Beginnings and endings of Thai sentences, learned from paragraphs."""

    beginnings: BitSet = field(default_factory=BitSet)
    endings: BitSet = field(default_factory=BitSet)


def _shape(text: str) -> str:
    return re.sub(r"\d+(?:[.,]\d+)*", "0", text)


def script_parts(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether Thai) of stretches of lines of one script, none of which reaches beyond a paragraph.

    A line is Thai if more than a fifth of it is, and of another script if it holds at
    least four words of that; figures and the like belong to the lines before them.
    """
    found: list[tuple[int, int, bool]] = []
    held: list | None = None
    at = 0
    for line in text.split("\n"):
        end, bare = at + len(line), line.strip()
        if not bare:
            if held:
                found.append((held[0], held[1], bool(held[2])))
            held = None
        else:
            thai = len(THAI.findall(bare))
            kind = True if 5 * thai > len(bare) else False if len(WORDS.findall(bare)) > 3 else None
            if held and (kind is None or held[2] is None or held[2] == kind):
                held[1:] = [end, held[2] if kind is None else kind]
            else:
                if held:
                    found.append((held[0], held[1], bool(held[2])))
                held = [at, end, kind]
        at = end + 1
    if held:
        found.append((held[0], held[1], bool(held[2])))
    return found


def thai_ends(body: str, model: ThaiModel) -> list[int]:
    """Ends of the sentences of a Thai paragraph: before a gap and a learned beginning, and at a learned ending of it."""
    ends = []
    for m in GAP.finditer(body):
        left, right = body[max(0, m.start() - 12) : m.start()], _shape(body[m.end() : m.end() + 24])[:BEGINNING]
        if not right or not THAI.search(body, body.rfind("\n", 0, m.start()) + 1, m.start()):
            continue
        if right in model.beginnings and _shape(left)[-ENDING:] in model.endings:
            ends.append(m.start())
    tail = body.rstrip()
    while tail and not THAI.search(tail[tail.rfind("\n") + 1 :]) and "\n" in tail:
        tail = tail[: tail.rfind("\n")].rstrip()
    if tail and _shape(tail[-12:])[-ENDING:] in model.endings and (" " in tail or len(tail) > 24):
        ends.append(len(tail))
    return ends


def _thai_paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, whole in zip(batch["text"], batch["whole"], strict=True):
            places = [(a, b) for a, b, thai in script_parts(text) if thai]
            for k, (a, b) in enumerate(places):
                body = _shape(text[a:b].strip())
                if " " in body or len(body) > 24:
                    rows.append((body, bool(k or whole), bool(k + 1 < len(places) or whole)))
        yield pd.DataFrame(rows, columns=["body", "begins", "ends"])


def _thai_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
        for body, begins, ends in zip(batch["body"], batch["begins"], batch["ends"], strict=True):
            counts["b", body[:BEGINNING]][0] += begins
            counts["e", body[-ENDING:]][0] += ends
            counts["b", body[:BEGINNING]][1] += 1
            counts["e", body[-ENDING:]][1] += 1
            for m in GAP.finditer(body):
                counts["b", body[m.end() : m.end() + BEGINNING]][1] += 1
                counts["e", body[max(0, m.start() - ENDING) : m.start()]][1] += 1
        yield pd.DataFrame([(k, e, n, every) for (k, e), (n, every) in counts.items()], columns=["kind", "edge", "n", "every"])


def learn_thai(texts: DataFrame) -> ThaiModel:
    """Beginnings and endings from all paragraphs of `texts` (text, whole); whole marks texts that begin and end with a sentence.

    Paragraphs that differ, digits being alike, count once. An edge counts if at least
    three begin, or end, with it, and these are at least one in 200 of all places at a gap
    where its characters stand.
    """
    different = texts.where(F.col("text").rlike("[\\u0E00-\\u0E7F]")).mapInPandas(_thai_paragraphs, "body string, begins boolean, ends boolean").groupBy("body").agg(F.bool_or("begins").alias("begins"), F.bool_or("ends").alias("ends"))
    edges = different.mapInPandas(_thai_edges, "kind string, edge string, n long, every long").groupBy("kind", "edge").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))
    kept = written(edges.where((F.col("n") >= EDGE_SUPPORT) & (EDGE_SHARE * F.col("n") >= F.col("every"))))
    return ThaiModel(*[bit_set(kept.where(F.col("kind") == kind), "edge") for kind in "be"])


def all_ends(text: str | None, model: ThaiModel) -> list[int]:
    """Ends of the sentences of a text in any of the languages, in order."""
    if not text or not THAI.search(text):
        return sentence_ends(text)
    thai = [(a, b) for a, b, is_thai in script_parts(text) if is_thai]
    ends: list[int] = []
    done = 0
    for a, b in [*thai, (len(text), len(text))]:
        ends += [done + e for e in sentence_ends(text[done:a])] if a > done else []
        ends += [a + e for e in thai_ends(text[a:b], model)] if b > a else []
        done = b
    return ends


def split_documents(df: DataFrame, id_col: str, text_col: str, model: ThaiModel, units: bool = True) -> DataFrame:
    """One row per sentence: id_col, sentence_no, start_pos, end_pos and, with `units`, its text without outer blanks.

    The last unit of a text that breaks off has end_pos NULL; only with `units`.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                start = 0
                for n, end in enumerate(all_ends(text, model)):
                    rows.append((i, n, start, end, text[start:end].strip() if units else None))
                    start = end
                if units and text and text[start:].strip():
                    rows.append((i, len(rows), start, None, text[start:].strip()))
            out = pd.DataFrame(rows, columns=["id", "sentence_no", "start_pos", "end_pos", "text"])
            out["end_pos"] = out["end_pos"].astype("Int64")
            yield out

    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").mapInPandas(run, f"id {kind}, sentence_no int, start_pos int, end_pos int, text string")
    return found.withColumnRenamed("id", id_col)
