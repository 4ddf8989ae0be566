"""Template residue, filler, error pages and script notices in place of content.

One automaton finds the phrases of all languages in one pass over the text without its code, quotations, logs and chats. A
sentence is a notice if a phrase or combination of phrases says so and the matched phrases cover most of its content
words, and a passage is matched if notices make up at least half of it. A sentence that merely mentions such a phrase is
covered too little. Made-up Latin, keyboard runs and repeated words are matched by their shape, and a sentence in which a
template left a value unfilled is matched as a whole, unless it speaks about templates. What is matched is held against
the length of the document: a line of residue in a long chapter does not exclude it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import residue_words as W

#: Least share of a sentence's content that its phrases must cover, of a passage that notices must make up, and of a
#: document that must be matched.
SENTENCE_COVER, COMBINED_COVER, PASSAGE_COVER, DOCUMENT_COVER = 0.6, 0.7, 0.5, 0.01
#: Doubtful marks of unfilled values, which ordinary writing has too, that a document must have to be believed.
DOUBTFUL = 2

_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`", re.S)
_HIDDEN = re.compile("[​-‏ -‮⁠-⁤﻿­]")
_LINE_END = re.compile("\r\n|[\r\v\f\x85\u2028]")
_TAG = re.compile(r"</?(?:html|head|title|body|h[1-6]|hr|p|div|span|br|noscript|center|b|i|a|ul|ol|li|details|summary|pre|code|script|style|meta|link|table|tr|td|th)\b[^<>]*>", re.I)
_LOG = re.compile(r"^\s*\S{6,30}\s+(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b")
_CHAT = re.compile(r"^\s*\[\d{1,2}:\d\d(?::\d\d)?\]\s*[\w.-]+:\s*")
_TRACE = re.compile(r"^\s*(?:at\s+[\w.$<>]+\s*\(.*\)|File \".*\", line \d+.*|Traceback \(most recent call last\):)\s*$")
_JSON = re.compile(r"^\s*[{\[].*[}\]]\s*$", re.S)
_BULLET = re.compile(r"^\s*(?:[-*•]\s+|\d{1,3}[.)]\s+|\d{1,2}:\d\d\s+|#+\s+)")
_QUOTED = re.compile(r"\"[^\"\n]{2,200}\"|“[^”\n]{2,200}”|„[^“”„\n]{2,200}[“”„]|«\s[^»\n]{2,200}\s»|»[^«\n]{2,200}«|「[^」\n]{2,200}」|『[^』\n]{2,200}』|“[^”\n]{2,200}”")
_URL = re.compile(r"https?://\S+|www\.\S+")
_SPLIT = re.compile(r"(?<=[.!?])\s+|(?<=[。!?！？])|\n+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_STATUS = re.compile(r"(?<!\d)[45]\d\d(?!\d)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿々ー]")

#: What opens any mark of an unfilled value: a quick look saves the search for most texts.
_OPENS = re.compile(r"&lt;|\{[\w{%!#]|\[[\w\[%*]|<[\w<%?#]|«[a-zA-Z]|\$[{A-Z]|#\{|##[A-Z]|%[\w(=]|@[@A-Z]|!![A-Z]|~~[A-Z]|\|\|[A-Z]|\*\||--[A-Z]|__[_A-Z]|xxx|XXX|undefined|\(T|\(F")
#: Marks that nothing but a template leaves behind.
_SLOT = re.compile(
    r"""\{\{\{?[^{}\n]{1,120}\}?\}\} | [$\#]\{[^{}\s]{1,60}\} | (?<![\w{$\#%])\{[^\W\d][\w\ .-]{0,40}\}(?!\}) | (?<![\w%])%[A-Z][A-Z0-9_]*% | (?<!\S)%[a-z][a-z0-9_]+%(?!\w) | @@\w[\w\ ]{0,40}@@
    | \[\[\w[\w\ ]{0,40}\]\] | <<\w[\w\ ]{0,40}>> | --[A-Z][A-Z0-9_]+-- | (?<!\w)__[A-Z][A-Z0-9_]+__(?!\w) | \$[A-Z][A-Z0-9_]{2,}\$ | «[a-z][a-z_\ ]{0,40}(?<!\ )» | «[A-Z][A-Z_\ ]{1,40}(?<!\ )»
    | \[%=?\s*[\w.\ ]{1,60}\s*%\] | \{%=?\s*\w+\s*%\} | <%=?\s*[\w.\ ]{1,60}\s*%> | <[A-Z][A-Z0-9_]*(?:\ [A-Z0-9_]+)*> | %\([a-z_]+\)[sdif] | &lt;\w[\w\ -]{0,60}&gt; | (?<![\w^_}\\{])\{0\}(?!\}) | \*\|[A-Z][A-Z0-9_:]+\|\* | \#\#[A-Z][A-Z0-9_]+\#\# | ~~[A-Z][A-Z0-9_]+~~ | !![A-Z][A-Z0-9_]+!! | \|\|[A-Z][A-Z0-9_]+\|\|
    | (?<!\S)@[A-Z][A-Z0-9_]+@(?!\w) | \{![\w.]{1,60}\} | \{\#\s*\w{1,60}\s*\#\} | <\#\s*[\w.]{1,60}\s*\#> | <\?=?\s*\$?[\w.>()-]{1,60}\s*\?> | \[\*\w{1,60}\*\] | \[object\ Object\]
    | <(?:your|my|insert|enter|add)[-_\ ][\w\ -]{1,40}> | <[a-z]+(?:[-_][a-z]+)+>
    | [\[<](?:insert|enter|add|your|name\ of)\b[^\]>\n]{0,60}[\]>] | [\[<][^\]>\n]{0,60}?(?:fill\ in|goes\ here|einsetzen|einfügen|eintragen|eingeben|ausfüllen|insérer|saisir|remplir|à\ compléter|insertar|rellenar|completar|inserir|preencher|вставить|вставьте|указать|укажите|заполнить|ввести|挿入|入力|記入|插入|填写|填入|输入)[^\]>\n]{0,40}[\]>]
    | \((?:TODO|TBD|FIXME|FILL\ IN)\b[^)\n]{0,60}\) | (?<=\w\ )_{4,}(?!\w) | _{4,}(?=\ \w)""",
    re.X,
)
#: Marks that ordinary writing has too.
_DOUBTFUL = re.compile(r"<[a-z]{3,20}>|(?<![\w{])\{\d{1,2}\}(?!\})|(?<!\S)%[sdifSD](?!\w)|(?<!\w)[xX]{3,}(?!\w)|(?<!\w)undefined(?!\w)|\[(?:[A-Z][a-zA-Z]*)(?:\ [A-Z][a-zA-Z]*){0,4}\](?!\()")
_GAP = re.compile(r"\n[ \t]*\n")
_TALK_GAP = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")


def _listed(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"[|\n]", text) if p.strip()]


@cache
def _automaton() -> ahocorasick.Automaton:
    kinds: dict[str, set[str]] = {}
    for kind, text in W.PHRASES.items():
        for phrase in _listed(text):
            kinds.setdefault(phrase, set()).add(kind)
    for run in W.KEY_RUNS.split():
        kinds.setdefault(run, set()).add("keys")
    auto = ahocorasick.Automaton()
    for phrase, found in kinds.items():
        auto.add_word(phrase, (len(phrase), frozenset(found)))
    auto.make_automaton()
    return auto


@cache
def _talk() -> re.Pattern:
    words = sorted(_listed(W.TALKS_OF_TEMPLATES), key=len, reverse=True)
    return re.compile("|".join(re.escape(w) if _CJK.search(w) else rf"(?<!\w){re.escape(w)}(?!\w)" for w in words))


#: Kinds of which one is enough to look at a passage closely; the others need their partner.
_ALONE = frozenset({"error", "script", "filler", "keys"})
_TOGETHER = (("unable", "access"), ("scripts", "switch"), ("write", "here"))


def _worth(kinds: set[str], passage: str) -> bool:
    """Whether phrases of these kinds may make a notice."""
    return bool(kinds & _ALONE) or any(a in kinds and b in kinds for a, b in _TOGETHER) or ("failure" in kinds and bool(_STATUS.search(passage)))


#: Sorts of notices: the kind that speaks for itself and the pair of kinds that does together.
_SORTS = {"error": ("error", "unable", "access"), "script": ("script", "scripts", "switch"), "filler": ("filler", "write", "here")}
_OF = {
    "error": frozenset({"error", "failure", "unable", "access", "around_error", "around"}),
    "script": frozenset({"script", "scripts", "switch", "around_script", "around"}),
    "filler": frozenset({"filler", "write", "here", "around_filler", "around"}),
}
#: A word after which a value is expected, or a letter of a language that is written without blanks.
_GIVES_VALUE = re.compile(rf"(?i:(?:^|[^\w])(?:{'|'.join(map(re.escape, W.BEFORE_VALUES.split()))})\s)$|[぀-ヿ㐀-鿿]\s?$")
_FUNCTION = frozenset(W.FUNCTION_WORDS.split())
_NO_SLOTS, _VALUE_NAMES = frozenset(_listed(W.BRACKETED)), frozenset(W.VALUE_NAMES.split())
_KEYS = re.compile("(?:" + "|".join(re.escape(k) for k in sorted(W.KEY_RUNS.split(), key=len, reverse=True)) + ")+;?")
_KEY_STARTS = frozenset(k[:3] for k in W.KEY_RUNS.split())
_LATIN = tuple(sorted(W.LATIN_ENDINGS.split(), key=len, reverse=True))


def plain(text: str) -> str:
    """The text without code, hidden characters, markup and odd line ends; compatibility forms are unified."""
    text = _LINE_END.sub("\n", text).replace("\u2029", "\n\n")
    if "`" in text or "~~~" in text:
        text = _CODE.sub(" ", text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    return text if text.isascii() else unicodedata.normalize("NFKC", text.replace("’", "'"))


def _lower(text: str) -> str:
    """Lower case, letter by letter where the length would change."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def unfilled(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of running text in which a value of a template was left unfilled."""
    if not _OPENS.search(text) and "____" not in text:
        return []
    sure, doubtful, marks, at = [], [], 0, 0
    for sentence in _TALK_GAP.split(text):
        at = text.index(sentence, at)
        bare = _QUOTED.sub(" ", sentence)
        strong, weak = _SLOT.search(bare), [m for m in _DOUBTFUL.finditer(bare) if _lower(m.group().strip("[]")) not in _NO_SLOTS]
        strong = strong or any(_GIVES_VALUE.search(bare[max(0, m.start() - 12) : m.start()]) and (m.group()[0] != "[" or _VALUE_NAMES & set(_lower(m.group()[1:-1]).split())) for m in weak)
        if (strong or weak) and not _LOG.match(sentence) and not _talk().search(_lower(sentence)):
            if _WORD.search(_DOUBTFUL.sub(" ", _SLOT.sub(" ", sentence))):
                (sure if strong else doubtful).append((at, at + len(sentence)))
                marks += 0 if strong else len(weak)
        at += len(sentence)
    return sorted(sure + doubtful) if sure or marks >= DOUBTFUL else []


@lru_cache(200_000)
def _weight(word: str) -> int:
    """Content characters of a word: none for function words, numbers and codes."""
    if _CJK.search(word):
        return sum(not c.isdigit() for c in word)
    return 0 if word in _FUNCTION or any(map(str.isdigit, word)) else len(word)


def _notice(sentence: str) -> tuple[int, float, str]:
    """Content characters of a sentence, the share that phrases cover, and the sort of notice that they make it, if any."""
    words = [m for m in _WORD.finditer(sentence) if _weight(m.group())]
    total = sum(_weight(m.group()) for m in words)
    if not total:
        return 0, 0.0, ""
    marked: list[tuple[int, int, frozenset]] = []
    kinds: set[str] = set()
    for end, (n, found) in _automaton().iter(sentence):
        start = end - n + 1
        if not _CJK.match(sentence[end]):
            after = sentence[end + 1 : end + 2]
            if after and (after.isalnum() or after == "_") and not _CJK.match(after):
                continue
        if start and not _CJK.match(sentence[start]):
            before = sentence[start - 1]
            if (before.isalnum() or before == "_") and not _CJK.match(before):
                continue
        marked.append((start, end + 1, found))
        kinds |= found
    best, notice = 0.0, ""
    for sort, (alone, one, other) in _SORTS.items():
        covered = bytearray(len(sentence))
        for a, b, found in marked:
            if found & _OF[sort]:
                covered[a:b] = b"\1" * (b - a)
        share = sum(min(_weight(m.group()), sum(covered[m.start() : m.end()])) for m in words) / total if any(covered) else 0.0
        best = max(best, share)
        together = one in kinds and other in kinds or (sort == "error" and "failure" in kinds and _STATUS.search(sentence))
        if not notice and (alone in kinds and share >= SENTENCE_COVER or together and share >= COMBINED_COVER):
            notice = sort
    return total, best, notice


def _shaped(words: list[str]) -> bool:
    """Made-up Latin, keyboard runs or a few words over and over."""
    n = len(words)
    if n >= 3 and sum(w[:3] in _KEY_STARTS for w in words) >= 0.6 * n and sum(bool(_KEYS.fullmatch(w)) for w in words) >= 0.6 * n:
        return True
    if n >= 4 and len(set(words)) <= min(3, max(1, n // 4)) and len(words[0]) > 1:
        return True
    if n == 3 and len(set(words)) == 1 and len(words[0]) > 3:
        return True
    letters = [w for w in words if len(w) > 2 and w.isascii() and w.isalpha()]
    if len(letters) >= 6 and len(letters) >= 0.8 * n:
        small = sum(w in _FUNCTION for w in words) / n
        return small <= 0.12 and sum(w.endswith(_LATIN) for w in letters) >= 0.6 * len(letters)
    return False


def _odd_shape(words: list[str]) -> bool:
    """A quick look: whether words are repeated at once or function words are so few that a passage may be made up."""
    n = len(words)
    if n < 3:
        return False
    return any(a == b for a, b in zip(words, words[1:])) or len(set(words)) <= max(3, n // 4) or sum(w in _FUNCTION for w in words) <= 0.12 * n


def _matched(passage: str, low: str) -> list[tuple[str, int]]:
    """``(sort, characters)`` of what stands in place of content in a passage, given in lower case too; empty if that is less than half of it."""
    pairs = zip(passage.split("\n"), low.split("\n"))
    lines = [y for x, y in pairs if not x.lstrip().startswith((">", "|")) and not _LOG.match(x) and not _CHAT.match(x) and not _TRACE.match(x)]
    text = "\n".join(_BULLET.sub("", x) for x in lines)
    if _JSON.match(text):
        text = re.sub(r"[{}\[\]\":,]+", " ", text)  # the body of an answer: its strings are no quotations
    text = _URL.sub(" ", text)
    words = re.findall(r"[^\W_]+;?", _QUOTED.sub(" ", text))
    if _odd_shape(words) and _shaped(words):
        return [("filler", len(text))]
    total = extra = 0
    found: list[tuple[str, int]] = []
    text = _QUOTED.sub(lambda m: " ␟" + "q" * len(m.group()) + " ", text)
    for sentence in _SPLIT.split(text):
        if next(_automaton().iter(sentence), None) is None:
            n, share, sort = sum(map(_weight, _WORD.findall(sentence))), 0.0, ""
        else:
            n, share, sort = _notice(sentence)
        total += n
        if sort or (n and _odd_shape(words := re.findall(r"[^\W_]+;?", sentence)) and _shaped(words)):
            found.append((sort or "filler", n))
        elif share >= COMBINED_COVER:
            extra += n  # goes along with a notice
    notices = sum(n for _, n in found)
    return found if found and notices + extra >= PASSAGE_COVER * total else []


def examine(text: str | None) -> tuple[bool, float, list[tuple[str, int, int]]]:
    """Whether a text is residue, the share of it that is matched, and ``(sort, start, end)`` of the matched stretches.

    The places are those of ``plain(text)``. Sorts are error, script, filler and unfilled. Null, empty and blank texts are
    not residue.
    """
    if not text or not text.strip():
        return False, 0.0, []
    text = plain(text)
    total = len("".join(text.split()))
    if not total:
        return False, 0.0, []
    spans = [("unfilled", a, b) for a, b in unfilled(text)]
    low = _lower(text)
    hits = [(end, found) for end, (_, found) in _automaton().iter(low)]
    at = seen = 0
    for gap in [*_GAP.finditer(low), None]:
        start, stop = at, gap.start() if gap else len(low)
        at = gap.end() if gap else stop
        passage = low[start:stop]
        kinds: set[str] = set()
        while seen < len(hits) and hits[seen][0] < stop:
            kinds |= hits[seen][1]
            seen += 1
        if _worth(kinds, passage) or _odd_shape(passage.split()):
            sorts = _matched(text[start:stop], passage)
            if sorts:
                spans.append((max(sorts, key=lambda x: x[1])[0], start, stop))
    spans.sort(key=lambda x: (x[1], x[2]))
    covered, reach = 0, 0
    for _, a, b in spans:  # what is matched twice counts once
        covered += len("".join(text[max(a, reach) : b].split())) if b > reach else 0
        reach = max(reach, b)
    return covered > 0 and covered >= DOCUMENT_COVER * total, covered / total, spans


def is_residue(text: str | None) -> bool:
    """Whether a text, or a passage of it that makes up enough of it, is residue. Null, empty and blank texts are not."""
    return examine(text)[0]


FLAGS = "is_residue boolean, coverage double, spans array<struct<sort:string,start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("sort", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def flag_residue(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``documents`` reduced to ``keep`` and the FLAGS of :func:`examine`, row by row in Arrow batches; whole texts, no shuffle."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [examine(t) for t in b.column(b.num_columns - 1).to_pylist()]
            spans = [[{"sort": s, "start": i, "stop": j} for s, i, j in f[2]] for f in found]
            cols = [pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*[f"k{i}" for i in range(len(keep))], "is_residue", "coverage", "spans"])

    rows = documents.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(FLAGS).fields])
    out = rows.mapInArrow(flag, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "is_residue", "coverage", "spans")
