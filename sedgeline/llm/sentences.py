"""P10. Sentence boundaries by statistics learned from the corpus itself, without labels.

Learning takes one pass over all documents, combined map-side, that counts by
language how often a word opens a sentence at a sure place (start of a paragraph, after an
end mark that no abbreviation can carry), how often it stands elsewhere, and
which word follows "t." for every token t.

1. Log-likelihood ratios (Dunning) of the first two tell the sentence starters
   and the words that never start one.
2. The counts after "t." are joined with the starters. A t followed by
   starters significantly less often than real ends are is an abbreviation (also the
   class of numbers, where a language writes ordinals with a full stop), and
   the pairs "t. w" with w in lower case are its collocations.

Then every mark is classified: a full stop by its token (abbreviation, initial,
number, part of an address) and the next word (starter, collocation, letter case); "!" and "?"
by the next word; marks of scripts that have their own always end. Texts that lack
capitals are noticed by themselves, and the starters then stand in for case.

Only words above SHARE of a language's words enter the model, so it has at most
2/SHARE entries a language at any size of the corpus.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.session import cut, maybe_broadcast, width

SHARE, LEAST = 1e-5, 5
#: Dunning's ratio at the 0.1 % level; signs that may stand between a mark and the word after it.
SIGNIFICANT, SIGNS = 10.83, 6
#: Words before and after a mark that tell the language there.
BEFORE, AFTER = 12, 5
MARKS, CLOSERS, OPENERS = ".!?…。！？؟।॥｡", ")]»”\"’」』）】›", "(["
TAG = re.compile(r"<[^>]*>")
EMPTY_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
BULLET = re.compile(r"[^\S\n]*(?:([-*•])|(\d{1,3})\.)(?=\s)")
MARK = re.compile(f"[{MARKS}]+")
EMOJI = "[☀-➿⬀-⯿\U0001f000-\U0001faff][️‍♀♂☀-➿\U0001f000-\U0001faff]*"
TAIL = re.compile(rf"(?:[{re.escape(CLOSERS)}]|\s*{EMOJI})*")
SMILES = re.compile(rf"(?:\s*{EMOJI})+")
LETTER = re.compile("[A-Za-z]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
TOKEN = re.compile(r"[^\s\"“”„«»(\[「」（]+$")
PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "‹": "›"}
ENDINGS = frozenset(CLOSERS)
QUOTES = re.compile(r"[\"“”„«»「」『』()（）\[\]【】《》‹›]")
SCRIPTS = [("th", "฀", "๿"), ("hi", "ऀ", "ॿ"), ("ar", "؀", "ۿ"), ("ru", "Ѐ", "ӿ"), ("cjk", "぀", "ヿ"), ("cjk", "㐀", "鿿")]
#: A long word, a full stop and a letter, not within an address.
LONG_STOP = re.compile(r"(?<![.\w])[^\W\d_]{5,}\.\s*([^\W\d_])(?!\w*[./]\w)")
#: What makes letters beside a full stop an initial or part of an address.
INITIAL, ADDRESS = re.compile(r"[^\W\d_]{1,2}\."), re.compile(r"\w+\.\w+[/.]")
#: Log share of a word that a language lacks.
UNSEEN = -12.0
THAI = re.compile("[\u0e00-\u0e7f]")
THAI_BREAK = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
NUMBER = "#"


@functools.lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    for name, a, b in SCRIPTS:
        if a <= ch <= b:
            return name
    return "latin" if ch.isalpha() else ""


def blank_tags(text: str) -> str:
    """The text with markup as blanks of the same length."""
    return TAG.sub(lambda m: " " * len(m.group()), text) if "<" in text else text


def paragraphs(s: str) -> list[tuple[int, int]]:
    """Ranges between empty lines, each list item a range of its own."""
    out, at = [], 0
    for m in [*EMPTY_LINE.finditer(s), None]:
        end = m.start() if m else len(s)
        start, line, listed = at, at, None
        while line < end:
            stop = s.find("\n", line, end)
            stop = end if stop < 0 else stop
            b = BULLET.match(s, line, end)
            if b:
                before = s[start:line].rstrip()
                if b.group(1) or not before or listed or before[-1] in MARKS + ":":
                    if before:
                        out.append((start, line))
                    start, listed = line, True
            listed = bool(listed)
            line = stop + 1
        if s[start:end].strip():
            out.append((start, end))
        at = m.end() if m else len(s)
    return out


def outer_pairs(s: str) -> list[tuple[int, int]]:
    """Quotations and brackets that are not within another; what has no partner is ignored."""
    if not QUOTES.search(s):
        return []
    stack: list[tuple[str, int]] = []
    opened: dict[str, list[int]] = defaultdict(list)  # by closing sign the places in the stack that it may close
    found = []

    def push(ch: str, i: int) -> None:
        for c in set(PAIRS.get(ch) or '"'):
            opened[c].append(len(stack))
        stack.append((ch, i))

    def drop(k: int) -> None:
        for x, _ in stack[k:]:
            for c in set(PAIRS.get(x) or '"'):
                opened[c].pop()
        del stack[k:]

    for m in QUOTES.finditer(s):
        ch, i = m.group(), m.start()
        k = opened[ch][-1] if opened[ch] else None
        if ch == '"':
            after = s[i + 1 : i + 2]
            if k is not None and not (after.isalnum() and (i == 0 or s[i - 1].isspace())):
                found.append((stack[k][1], i))
                drop(k)
            elif after and not after.isspace():
                push(ch, i)
        elif k is not None and not (ch in PAIRS and stack[k][0] != "„"):
            found.append((stack[k][1], i))
            drop(k)
        elif ch in PAIRS:
            push(ch, i)
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


@dataclass
class Spot:
    """A place where a sentence may end."""

    mark: int
    end: int
    kind: str  # mark, or close (a pair with a mark at its inner end)
    marks: str
    opened: int = -1


def spots(s: str) -> list[Spot]:
    pairs = outer_pairs(s)
    begins = {a: b for a, b in pairs}
    out = []
    k = 0
    for m in MARK.finditer(s):
        while k < len(pairs) and pairs[k][1] < m.start():
            k += 1
        if k < len(pairs) and pairs[k][0] < m.start():
            continue
        out.append(Spot(m.start(), m.end(), "mark", m.group()))
    for a, b in pairs:
        inner = s[a + 1 : b].rstrip()
        if inner and inner[-1] in MARKS:
            out.append(Spot(a + len(inner), b + 1, "close", inner[-1], a))
    out.sort(key=lambda x: x.end)
    plain = s.isascii()
    for x in out:
        e = x.end
        while not (plain and s[e : e + 1] not in ENDINGS):
            m = (SMILES if e in begins else TAIL).match(s, e)
            n = m.end() if m else e
            opened = next((p for p in range(e, n) if p in begins), None)
            if opened is not None:
                n = opened
                n = e + len(s[e:n].rstrip())
            if n == e:
                break
            e = n
            if opened is not None:
                break
        x.end = e
    return out


def next_word(s: str, at: int) -> tuple[int, str, str]:
    """Where the next visible character stands, it, and the word that follows (opening signs skipped)."""
    n = len(s)
    while at < n and s[at].isspace():
        at += 1
    if at >= n:
        return n, "", ""
    i = at
    while i < n and not s[i].isalnum() and i - at < SIGNS:
        i += 1
    m = WORD.match(s, i)
    return at, s[at], m.group() if m else ""


def token_before(s: str, mark: int) -> str:
    size = 40
    while True:  # a longer piece is looked at only where the token fills the one before
        begin = max(0, mark - size)
        m = TOKEN.search(s, begin, mark)
        if not m or m.start() > begin or not begin:
            return m.group() if m else ""
        size *= 4


def kind_of(token: str) -> str:
    """The type of a token: lower case, numbers as one class."""
    return NUMBER if token and all(c.isdigit() or c in ".," for c in token) else token.lower().lstrip("¿¡-–—*•")


def label(lang: str | None) -> str:
    return re.split(r"[-_]", lang.strip().lower())[0] if lang else ""


def main_script(s: str) -> str:
    if s.isascii():
        return "latin" if LETTER.search(s) else ""
    seen: Counter = Counter()
    for c, n in Counter(s).items():
        seen[script(c)] += n
    seen.pop("", None)
    return seen.most_common(1)[0][0] if seen else ""


def lacks_capitals(s: str, blocks: list[tuple[int, int]]) -> bool:
    """Whether sentences begin in lower case, by the starts of paragraphs and what follows long words and a full stop."""
    low = up = 0
    for a, b in blocks:
        for m in LONG_STOP.finditer(s, a, b):
            low += m.group(1).islower()
            up += m.group(1).isupper()
        first = next_word(s[a:b], 0)[2][:1] if MARK.search(s, a, b) else ""  # headings may keep their capital
        low += first.islower()
        up += first.isupper()
    return low > up


def openings(t: str, marks: list[Spot]) -> list[str]:
    """Words at sure starts within a paragraph."""
    out = []
    if not BULLET.match(t):
        out.append(next_word(t, 0)[2])
    for x in marks:
        if x.marks[-1] != "…" and x.marks != "...":
            at, c, w = next_word(t, x.end)
            if not w or at == x.end and script(c) != "cjk":
                continue
            if x.marks == ".":
                own = token_before(t, x.mark)
                if len(own) < 5 or not own.isalpha():
                    continue
            if not w[0].islower():
                out.append(w)
    return out


def key_of(lang: str, main: str) -> str:
    return lang if main == "latin" else main


@dataclass
class Model:
    """What was learned: by language the starters, the words that never start, abbreviations, collocations, word shares."""

    starters: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    never: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    short: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    pairs: set[tuple[str, str, str]] = field(default_factory=set)
    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.any_short = set().union(*self.short.values())
        self.any_starter = set().union(*self.starters.values())
        self.names = sorted(self.prior)
        self.base = np.array([self.prior[k] for k in self.names])
        self.index = {w: i + 1 for i, w in enumerate(self.shares)}
        self.rows = np.array([[0.0] * len(self.names), *([p.get(k, UNSEEN) for k in self.names] for p in self.shares.values())])


class Languages:
    """The languages of the marks of a text, among those in Latin script, by sums over the words around."""

    def __init__(self, model: Model, s: str, marks: list[int]) -> None:
        words, self.upto, at = [], [], 0
        for m in marks:
            words += WORD.findall(s, at, m)
            self.upto.append(len(words))
            at = m
        words += WORD.findall(s, at)
        get = model.index.get
        ids = np.array([get(w.lower(), 0) for w in words], np.int64)
        self.m, self.marks, self.n = model, marks, len(words)
        self.known = np.concatenate([[0], np.cumsum(ids > 0)])
        self.sums = np.concatenate([np.zeros((1, len(model.names))), np.cumsum(model.rows[ids], axis=0)])

    def at(self, mark: int, fallback: str) -> str:
        k = self.upto[bisect_left(self.marks, mark)]
        a, b = max(0, k - BEFORE), min(self.n, k + AFTER)
        return self.m.names[int((self.m.base + self.sums[b] - self.sums[a]).argmax())] if self.known[a] < self.known[b] else fallback


def dunning(k1: float, n1: float, k2: float, n2: float) -> float:
    """Log-likelihood ratio of two binomial counts."""

    def ll(k: float, n: float, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n - k else 0.0)

    if not n1 or not n2:
        return 0.0
    p = (k1 + k2) / (n1 + n2)
    return 2 * (ll(k1, n1, k1 / n1) + ll(k2, n2, k2 / n2) - ll(k1, n1, p) - ll(k2, n2, p))


class Counts:
    """Sums by language and kind: words that open (start) and stand elsewhere (else), all words, and what follows "t."."""

    def __init__(self) -> None:
        self.by: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.size = 0

    def add(self, text: str, lang: str | None) -> None:
        """Counts a text that has capitals or a script without them."""
        s = blank_tags(text)
        main = main_script(s)
        key = key_of(label(lang), main)
        if not key or main in ("", "th", "cjk"):
            return
        blocks = paragraphs(s)
        if lacks_capitals(s, blocks):
            return
        cased = main in ("latin", "ru")
        start, rest, follow = self.by[key, "start"], self.by[key, "else"], self.by[key, "follow"]
        for a, b in blocks:
            t = s[a:b]
            ws, marks = WORD.findall(t), [x for x in spots(t) if x.kind == "mark"]
            first = [w.lower() for w in openings(t, marks) if not w.isupper() or len(w) == 1]
            start.update(first)
            if cased:
                rest.update([w for w in ws if w.islower()])
            else:
                rest.update(Counter(w.lower() for w in ws) - Counter(first))
            self.by[key, "all"][""] += len(ws)
            follow.update(followers(t, marks))
            self.size += len(ws)

    def frame(self) -> pd.DataFrame:
        rows = [(key, what, *(x if what == "follow" else (x, "")), n) for (key, what), own in self.by.items() for x, n in own.items()]
        return pd.DataFrame(rows, columns=["lang", "what", "word", "next", "n"])


def followers(t: str, marks: list[Spot]) -> list[tuple[str, str]]:
    """(token, word after it) of every single full stop; the word as it is where in lower case, after ^ and in lower case where it may start a sentence, else empty."""
    out, listed = [], bool(BULLET.match(t))
    for x in marks:
        if x.marks != "." or listed and x.mark < 6:
            continue
        token = kind_of(token_before(t, x.mark))
        if not token:
            continue
        at, c, w = next_word(t, x.end)
        if not c or at == x.end and c.isalnum():
            continue
        out.append((token, "" if not w or c.isdigit() else w if w[0].islower() else "^" + w.lower()))
    return out


def counted(documents: DataFrame) -> DataFrame:
    """(lang, what, word, next, n): the sums of ``Counts`` over all documents, combined in each task and then by key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Counts()
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                if text:
                    own.add(text, lang)
            if own.size > 2_000_000:
                yield own.frame()
                own = Counts()
        yield own.frame()

    return documents.mapInPandas(run, "lang string, what string, word string, next string, n long").groupBy("lang", "what", "word", "next").agg(F.sum("n").alias("n"))


def learn(documents: DataFrame) -> Model:
    """The model of a corpus (text, lang); all documents are counted."""
    rows = cut(counted(documents))
    totals = {r["lang"]: r["n"] for r in rows.where("what = 'all'").collect()}
    if not totals:
        return Model()
    model = Model()
    size = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("lang")]
    one = lambda what: F.sum(F.when(F.col("what") == what, F.col("n")).otherwise(0))
    words = rows.where("what in ('start', 'else')").groupBy("lang", "word").agg(one("start").alias("start"), one("else").alias("rest"))
    kept = words.where(F.col("start") + F.col("rest") >= F.greatest(F.lit(float(LEAST)), size * SHARE)).toPandas()
    whole = sum(totals.values())
    prior = {k: math.log(v / whole) for k, v in totals.items() if k not in {x[0] for x in SCRIPTS}}
    shares: dict[str, dict[str, float]] = {}
    for lang, own in kept.groupby("lang"):
        starts, rest = own["start"].sum(), own["rest"].sum()
        for w, a, b in zip(own["word"], own["start"], own["rest"]):
            more = a / max(1, starts) > b / max(1, rest)
            ratio = dunning(a, starts, b, rest)
            if more and a >= 3 and ratio > SIGNIFICANT or a >= LEAST and a > 0.05 * (a + b):
                model.starters[lang].add(w)
            elif not more and ratio > SIGNIFICANT / 2 and a < 0.02 * (a + b):
                model.never[lang].add(w)
            if lang in prior:
                shares.setdefault(w, {})[lang] = math.log((a + b) / totals[lang])
    starters = documents.sparkSession.createDataFrame([(k, w) for k, v in model.starters.items() for w in v], "lang string, opens string")
    follow = rows.where("what = 'follow'").withColumn("opens", F.ltrim(F.col("next"), F.lit("^")))
    known = follow.join(maybe_broadcast(starters.withColumn("known", F.lit(True)), 60), ["lang", "opens"], "left")
    known = cut(known.select("lang", F.col("word").alias("token"), "next", "n", F.coalesce("known", F.lit(False)).alias("known")))
    by = known.groupBy("lang", "token").agg(F.sum(F.when(F.col("known") & F.col("next").startswith("^"), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n"))
    base = {r["lang"]: (r["a"], r["n"]) for r in by.where("a > 0").groupBy("lang").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).collect()}
    for r in by.where((F.col("n") >= 3) & (F.col("n") >= SHARE * size / 10) & (F.col("a") < 0.75 * F.col("n"))).collect():
        a0, n0 = base.get(r["lang"], (0, 0))
        rate = max(0.5, a0 / n0) if n0 else 0.9
        own = script(r["token"][:1])
        fits = own in ("", r["lang"]) or own == "latin" and r["lang"] in prior
        need = SIGNIFICANT / 2 if len(r["token"]) <= 4 else 1.5 * SIGNIFICANT  # long tokens end sentences more often than they are abbreviations
        if fits and r["a"] / r["n"] < 0.75 * rate and dunning(r["a"], r["n"], rate * 10 * r["n"], 10 * r["n"]) > need:
            model.short[r["lang"]].add(r["token"])
    short = documents.sparkSession.createDataFrame([(k, t) for k, v in model.short.items() for t in v], "short_lang string, token string")
    beside = known.where(F.col("known") & ~F.col("next").startswith("^") & (F.col("n") >= SHARE * size / 10)).join(maybe_broadcast(short.select("token").distinct(), 60), "token", "left_semi")
    model.pairs = {(r["lang"], r["token"], r["next"]) for r in beside.select("lang", "token", "next").collect()}
    return Model(model.starters, model.never, model.short, model.pairs, shares, prior)


class Splitter:
    def __init__(self, model: Model) -> None:
        self.m = model

    def split(self, text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
        """Ranges of the sentences of a text, in code points."""
        if not text or not text.strip():
            return []
        s = blank_tags(text)
        blocks = paragraphs(s)
        self.main, self.lang = main_script(s), label(lang)
        self.thai = bool(THAI.search(s))
        self.uncased = self.main in ("latin", "ru", "cjk", "hi", "ar", "th") and lacks_capitals(s, blocks)
        out: list[tuple[int, int]] = []
        for a, b in blocks:
            out += self.block(s, text, a, b)
        return out

    def block(self, s: str, text: str, a: int, b: int) -> list[tuple[int, int]]:
        t = s[a:b]
        ends = []
        begin, self.languages = 0, None
        head, last = BULLET.match(t), len(t.rstrip())
        found = spots(t)
        self.marks = sorted({x.mark for x in found})
        for x in found:
            if head and x.mark < head.end() and x.kind == "mark":
                continue
            if x.end <= begin:
                continue
            if x.end >= last:
                break
            if self.ends(t, x, begin):
                ends.append(x.end)
                begin = x.end
        if self.thai and THAI.search(t):
            inside = outer_pairs(t)
            for m in THAI_BREAK.finditer(t):
                if not any(p < m.start() < q for p, q in inside):
                    ends.append(m.start())
            for m in TAG.finditer(text, a, b):  # markup beside Thai ends too
                p, q = m.start() - a, m.end() - a
                left, right = t[:p].rstrip()[-1:], t[q:].lstrip()[:1]
                if left and right and "th" in (script(left), script(right)):
                    ends.append(p)
        out, begin = [], 0
        for e in [*sorted(set(ends)), len(t)]:
            i, j = begin, e
            while i < j and blank(t[i]):
                i += 1
            while j > i and blank(t[j - 1]):
                j -= 1
            if i < j:
                out.append((a + i, a + j))
            begin = e
        return out

    def language(self, t: str, mark: int) -> str:
        if self.languages is None:
            self.languages = Languages(self.m, t, self.marks)
        return self.languages.at(mark, self.lang)

    # the classification of one mark
    def ends(self, t: str, x: Spot, begin: int) -> bool:
        at, c, w = next_word(t, x.end)
        gap, low = at > x.end, w.lower()
        near = script(c) or script(w[:1]) or self.main
        key = self.language(t, x.mark) if near == "latin" else near
        shout = len(w) > 1 and w.isupper() and token_before(t, x.mark).isupper()
        never = low in self.m.never.get(key, ())
        if x.kind == "close":
            if c in ",;:—–-，、" or (not gap and c == "."):
                return False
            if c in "\"“«„「(（[¿¡『":
                return True
            mid = bool(t[begin : x.opened].strip())
            if near == "cjk":
                return x.marks == "。" and not mid
            if near in ("hi", "ar", "th"):
                return not mid and low in self.m.starters.get(near, ())
            if c.islower() or shout:
                return (self.uncased or shout) and not never and not (mid and low not in self.m.starters.get(key, ()))
            return True
        if any(m in "。！？।॥｡" for m in x.marks):
            return True
        left = script(t[x.mark - 1 : x.mark]) if x.mark else ""
        if "…" in x.marks or x.marks.startswith(".."):
            if c.islower() or shout:
                return (self.uncased or shout) and not never
            return gap or near not in ("cjk", "th", "hi", "ar")
        if "!" in x.marks or "?" in x.marks or "؟" in x.marks:
            if not gap and c.isalnum():
                if near == "cjk" or left == "cjk":
                    return True
                if not c.isalpha() or re.search(r"[./=&@]\S", token_before(t, x.mark)):
                    return False
                return c.isupper() or (self.uncased and not never)
            if c in ",;:—–":
                return False
            if c.islower() or shout:
                return (self.uncased or shout) and not never
            return True
        return self.full_stop(t, x, begin, at, c, w, key, gap, left, near, shout, never)

    def full_stop(self, t, x, begin, at, c, w, key, gap, left, near, shout, never) -> bool:
        token = token_before(t, x.mark)
        low, own = w.lower(), kind_of(token)
        if left in ("th", "cjk") and near in ("th", "cjk") or left == "th":
            return False
        if c in ",;:)!?%/=&" and not gap:
            return False
        if not gap:
            if not c.isalpha() or not token or not token[-1].isalpha():
                return False
            if len(re.findall(r"[^\W\d_]", own)) < 2 or left in ("hi", "ar") and near == left or INITIAL.match(t, x.end):
                return False
            if "." in own or "/" in own or own in self.m.short.get(key, ()):
                return False
            if c.isupper():
                return token[-1].islower() or shout or self.uncased
            opens = low in self.m.starters.get(key, ()) or (self.uncased and not never)
            return opens and not ADDRESS.match(t, x.end)
        if c in ",;:—–":
            return False
        lang = key if script(own[:1]) in ("latin", "") else script(own[:1])
        letters = [p for p in own.split(".") if p]
        initial = len(letters) > 0 and all(len(p) == 1 and p.isalpha() for p in letters)
        if begin == 0 and initial and len(letters) == 1 and not t[: x.mark - len(token)].strip():
            return False  # a speaker or list mark such as "R."
        known = own in self.m.short.get(lang, ()) or own in self.m.short.get(self.lang, ())
        if c.islower() and not self.uncased:
            known = known or own in self.m.any_short
        foreign = not known and len(own) <= 3 and own.isalpha() and own in self.m.any_short
        if known or initial or foreign:
            if c.isdigit() or (len(w) == 1 and t[at + 1 : at + 2] == "."):
                return False
            starter = low in self.m.starters.get(key, ()) or foreign and low in self.m.any_starter
            if c.islower() or shout:
                return (self.uncased or shout) and starter and (lang, own, low) not in self.m.pairs
            return starter
        return True


def blank(ch: str) -> bool:
    return ch.isspace() or unicodedata.category(ch) in ("Cf", "Cc") and ch not in "‍"


SENTENCE = "doc_id long, start_char int, end_char int"


def sentences(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start_char, end_char): every sentence of every document, offsets in code points, end exclusive.

    Null, empty and blank texts have none. The model is learned from the same
    documents unless one is given; with too few documents for statistics only the rules for initials,
    numbers and scripts remain. A null lang counts under its text's script only.
    A repeated row gives its sentences again; a null doc_id stays null.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    if rows.rdd.getNumPartitions() < width(spark):
        rows = rows.repartition(width(spark))
    shared = spark.sparkContext.broadcast(model if model is not None else learn(rows.select("text", "lang")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Splitter(shared.value)
        for pdf in batches:
            ids, starts, ends = [], [], []
            for i, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                for a, b in own.split(text, lang):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"doc_id": ids, "start_char": starts, "end_char": ends})

    return rows.mapInPandas(run, SENTENCE)
