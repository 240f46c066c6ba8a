"""Spans and grounding of phrases in texts (Arrow UDFs, as offsets need more than one pass over a text)."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])
PIECE = re.compile(r"[^.!?\n]+(?:[.!?]+|$)", re.MULTILINE)
#: Characters of the longest context, and those taken around evidence without a sentence.
MOST, AROUND = 1200, 300
#: Typographic signs and their plain form (fixed values).
PLAIN = {"’": "'", "‘": "'", "`": "'", "´": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}


def pieces(text: str | None) -> list[tuple[int, int]]:
    """TX18: runs up to an end mark or line end, blanks at the ends left out."""
    out = []
    for m in PIECE.finditer(text or ""):
        own = m.group()
        a = m.start() + len(own) - len(own.lstrip())
        b = m.end() - (len(own) - len(own.rstrip()))
        if a < b:
            out.append((a, b))
    return out


@F.pandas_udf(T.ArrayType(SPAN))
def sentence_spans(text: pd.Series) -> pd.Series:
    """TX18 as a column; text[start:end] is the span's text."""
    return text.map(lambda t: [{"start": a, "end": b, "text": t[a:b]} for a, b in pieces(t)])


def context_of(text: str, spans: list[dict], most: int = MOST, around: int = AROUND) -> str:
    """TX19: the sentences that hold the evidence, each once, in order; a window around it where none does.

    Evidence whose offsets do not give its text is an error. Cut at ``most`` characters.
    """
    cuts: list[tuple[int, int]] = []
    own = pieces(text)
    for s in spans:
        a, b = s["start"], s["end"]
        if text[a:b] != s["text"]:
            raise ValueError(f"evidence {s['text']!r} does not stand at {a}..{b}")
        hit = [(x, y) for x, y in own if x < b and a < y] or [(max(0, a - around), min(len(text), b + around))]
        cuts += [h for h in hit if h not in cuts]
    return " ".join(text[a:b].strip() for a, b in sorted(cuts))[:most]


@F.pandas_udf(T.StringType())
def aspect_context(text: pd.Series, evidence: pd.Series) -> pd.Series:
    """TX19 as a column over array<struct<text,start,end>>."""
    return pd.Series([None if t is None or e is None else context_of(t, [dict(x) if not hasattr(x, "asDict") else x.asDict() for x in e]) for t, e in zip(text, evidence)], dtype=object)


@dataclass
class Folded:
    """A text in comparable form, and where each of its characters begins and ends in the original."""

    text: str
    begin: list[int]
    end: list[int]

    @classmethod
    def of(cls, given: str) -> Folded:
        out: list[tuple[str, int, int]] = []
        for i, c in enumerate(given):
            if c.isspace():
                if out and out[-1][0] == " ":
                    out[-1] = (" ", out[-1][1], i + 1)
                else:
                    out.append((" ", i, i + 1))
            else:
                out += [(x, i, i + 1) for x in PLAIN.get(c, c).casefold()]
        return cls("".join(c for c, _, _ in out), [a for _, a, _ in out], [b for _, _, b in out])

    def back(self, a: int, b: int) -> tuple[int, int]:
        return self.begin[a], self.end[b - 1]


def ground(phrase: str, text: str, least: float = 0.84) -> tuple[int, int] | None:
    """TX20-21: where a phrase stands in a text, or None.

    As it is written, else with white space, letter case and typography aside and quotes at its
    ends left out, else (three words and more) as the run of words, up to two more or fewer,
    whose characters are most alike, from a ratio of ``least`` on; of equal ones the shortest, then the first.
    """
    if phrase.strip() and (i := text.find(phrase)) >= 0:
        return i, i + len(phrase)
    want = Folded.of(phrase).text.strip(" \"'«»")
    if not want:
        return None
    held = Folded.of(text)
    if (i := held.text.find(want)) >= 0:
        return held.back(i, i + len(want))
    size = want.count(" ") + 1
    if size < 3:
        return None
    words = [m.span() for m in re.finditer(r"[^ ]+", held.text)]
    judge = difflib.SequenceMatcher(autojunk=False)
    judge.set_seq2(want)
    runs = []
    for n in range(max(1, size - 2), min(len(words), size + 2) + 1):
        for (a, _), (_, b) in zip(words, words[n - 1 :]):
            judge.set_seq1(held.text[a:b])
            if judge.real_quick_ratio() >= least and judge.quick_ratio() >= least and (r := judge.ratio()) >= least:
                runs.append((-r, n, a, b))
    return held.back(*min(runs)[2:]) if runs else None
