"""Texts that were extracted from pages, made whole: heads out, broken words joined, split paragraphs joined; and measures of prose."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.sources.texts import parsed

#: Words of the longest running head and how often it repeats.
HEAD_WORDS, HEAD_REPEATS = 12, 3
_WORD = re.compile(r"[A-Za-z]{2,}")


def without_heads(text: str) -> tuple[str, int]:
    """The text without short blocks that repeat, numbers alike, and without bare page numbers."""
    blocks = text.split("\n\n")
    keys = [re.sub(r"\d+", "#", b.strip()) if b.strip() and len(_WORD.findall(b)) <= HEAD_WORDS else None for b in blocks]
    often = {k for k, n in Counter(k for k in keys if k is not None).items() if n >= HEAD_REPEATS}
    kept = [b for b, k in zip(blocks, keys, strict=True) if k not in often and not re.fullmatch(r"\d{1,4}", b.strip())]
    return "\n\n".join(kept), len(blocks) - len(kept)


def joined_words(text: str) -> tuple[str, int]:
    """Words broken by a hyphen at a line end, or before a blank, made whole; the text is its own dictionary."""
    solid = {w.lower() for w in _WORD.findall(text)}
    dashed = {w.lower() for w in re.findall(r"[A-Za-z]{2,}-[a-z]{2,}", text)}
    n = 0

    def whole(m: re.Match) -> str:
        nonlocal n
        n += 1
        a, b = m.groups()
        return f"{a}-{b}" if (a + b).lower() not in solid and f"{a}-{b}".lower() in dashed else a + b

    text = re.sub(r"([A-Za-z]{2,})-[ \t]*\n[ \t]*\n?[ \t]*([a-z]+)", whole, text)
    text = re.sub(r"([A-Za-z]{2,})-[ \t]+([a-z]{2,})", lambda m: whole(m) if (m.group(1) + m.group(2)).lower() in solid else m.group(), text)
    return text, n


def reflowed(text: str) -> tuple[str, int]:
    """Blocks that go on in the next one joined with it: the first does not close, the second does not open."""
    out: list[str] = []
    n = 0
    for block in filter(None, (b.strip() for b in text.split("\n\n"))):
        before = out[-1] if out else ""
        open_end = before and before[-1] not in ".!?:;)]" and not (before[-1] in "'\"”" and before[-2:-1] in tuple(".!?:;)]")) and not before.startswith("#")
        if open_end and (block[0].islower() or block[0] in "([") and not re.match(r"\d+[.)]\s", block):
            out[-1] = f"{before} {block}"
            n += 1
        else:
            out.append(block)
    return "\n\n".join(out), n


def repaired(texts: DataFrame) -> DataFrame:
    """``path, text, heads, joined, reflowed``: the three steps in this order, with what each did."""

    def run(text: str) -> list[tuple]:
        text, heads = without_heads(text)
        text, words = joined_words(text)
        text, blocks = reflowed(text)
        return [(text, heads, words, blocks)]

    return parsed(texts, run, "text string, heads int, joined int, reflowed int")


def residue_ratio(texts: DataFrame, by: str = "path") -> DataFrame:
    """Share of words of a single letter: broken formulas leave many. 0 without words."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z\u00c0-\u024f][A-Za-z\u00c0-\u024f'’-]*"), 0)
    counted = texts.select(by, F.size(words).alias("n"), F.size(F.filter(words, lambda w: F.length(w) == 1)).alias("single"))
    return counted.groupBy(by).agg(F.when(F.sum("n") > 0, F.sum("single") / F.sum("n")).otherwise(F.lit(0.0)).alias("residue"))


def feature_table(blocks: DataFrame, by: str = "path", kinds: tuple[str, ...] = ("prose", "abstract", "remark")) -> DataFrame:
    """``by, feature, n, rate`` of every feature of the prose blocks (``by``, kind, text); rates per thousand words."""
    rows = blocks.filter(F.col("kind").isin(*kinds)).select(by, F.size(fn.words(F.col("text"))).alias("w"), *[c.alias(k) for k, c in fn.feature_counts(F.col("text")).items()])
    sums = rows.groupBy(by).agg(F.sum("w").alias("w"), *[F.sum(k).alias(k) for k in fn.FAMILIES])
    long = sums.select(by, "w", F.stack(F.lit(len(fn.FAMILIES)), *[x for k in fn.FAMILIES for x in (F.lit(k), F.col(k))]).alias("feature", "n"))
    return long.select(by, "feature", "n", fn.per_thousand(F.col("n"), F.col("w")).alias("rate"))


#: Words after "ask" that make it a question, persons that are asked, determiners and
#: prepositions that make it a requirement.
QUESTION = ("which", "what", "whether", "if", "how", "why", "when", "where", "who", "whom", "whose", "about", "by")
PERSONS = ("observer", "reader", "person", "people", "author", "subject", "oneself", "ourselves", "themselves", "himself", "herself", "us", "you", "me")
DETERMINERS = ("the", "a", "an", "every", "each", "all", "its", "their", "this", "these", "those", "one", "two", "no")
REQUIRING = ("for", "more", "less", "only", "much", "little", "nothing", "that", "too", "at", "of", "on", "along", "between", "throughout")


def is_requirement(after: str) -> bool:
    """Whether the words after a form of "ask" say that something is required."""
    words = re.findall(r"\([A-Z]+\d*\)|[A-Za-z]+", after)[:6]
    low = [w.lower() for w in words]
    if not low or not after[:1].isspace() or not re.match(r"\s+[A-Za-z(]", after) or low[0] in QUESTION:
        return False
    if any(re.fullmatch(r"questions?|problems?", w) for w in low[:3]):
        return False
    who = low[1:] if low[0] in ("all", "the", "a", "every", "each") else low
    if who and any(re.fullmatch(p + "s?", who[0]) for p in PERSONS):
        return False
    if low[0] == "to":
        return len(low) > 1 and (low[1] == "be" or low[1] in DETERMINERS)
    return low[0] in REQUIRING or low[0] in ("x", "it", "them") or low[0] in DETERMINERS or words[0].startswith("(") or "to" in low[1:3]


def asks(lines: DataFrame) -> DataFrame:
    """``path, line_no, said`` of requirements that are asked; ``lines``: path, line_no, line, next (the line after, as lookahead)."""

    def run(text: str) -> list[tuple]:
        line, _, then = text.partition("\x1f")
        plain = re.sub(r"\$[^$]*\$", " X ", f"{line} {then}")
        size = len(re.sub(r"\$[^$]*\$", " X ", line))
        return [(" ".join(plain[m.start() :].split()[:5]),) for m in re.finditer(r"(?i)\bask(?:s|ed)?\b", plain) if m.start() < size and is_requirement(plain[m.end() :])]

    keyed = lines.select(F.to_json(F.struct("path", "line_no")).alias("path"), F.concat_ws("\x1f", "line", F.coalesce("next", F.lit(""))).alias("text"))
    found = parsed(keyed, run, "said string").withColumn("k", F.from_json("path", "path string, line_no int"))
    return found.select("k.path", "k.line_no", "said")
