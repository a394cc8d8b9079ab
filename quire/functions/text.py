"""Scalar functions on typeset and plain text, as expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commands that carry metadata in an argument, flags, status tags, spaces between
#: a status tag and its note, and commands that refer to a label.
METADATA_COMMANDS = ("label", "lean", "uses", "notes", "ledger", "statedin", "restates")
FLAG_COMMANDS = ("leanok", "notready")
STATUS_COMMANDS = ("statusT", "statusA")
SPACE_COMMANDS = ("quad", "qquad")
REFERENCE_COMMANDS = ("ref", "eqref", "autoref", "cref", "Cref", "vref", "Vref")
#: Nouns that introduce a reference, and their plurals.
REFERENCE_NOUNS = {
    "Theorem": "Theorems", "Proposition": "Propositions", "Lemma": "Lemmas", "Corollary": "Corollaries", "Definition": "Definitions",
    "Example": "Examples", "Remark": "Remarks", "Section": "Sections", "Appendix": "Appendices",
}
#: The phrases of each family of prose features, and the marks that are counted.
#: ``a/b`` are alternatives of one word, ``(...)`` may be missing, ``...n`` stands for up to n words.
PHRASES = {
    "BOOSTER": ["crucially", "importantly", "notably", "indeed", "in fact", "essentially", "fundamentally", "precisely", "exactly what", "of course", "clearly"],
    "SALIENCE": ["it is worth noting/remarking/stressing", "worth noting", "note that", "notice that", "observe that", "it should be noted/stressed", "recall that", "bear in mind"],
    "SINCERITY": ["to be clear", "to be honest", "the honest assessment/answer", "in truth", "frankly", "let us be clear/direct", "it must be said"],
    "ADVERB": ["silently", "quietly", "gracefully", "cleanly", "faithfully", "seamlessly", "elegantly", "neatly", "effortlessly", "automatically"],
    "PARALADDER": ["in other words", "that is to say", "put differently", "put another way", "which is to say", "equivalently", "or rather"],
    "NEGPAR": ["not ...5 but( rather)", "is not ...5 [—;] it is", "rather than ...4 ,"],
    "REVEAL": ["what is really", "what is actually", "the real question/issue/point", "the point is", "the key insight/observation is", "the whole point", "what matters( here) is"],
    "ATTITUDE": ["elegant", "elegance", "remarkable", "remarkably", "striking", "strikingly", "beautiful", "powerful", "profound", "deep(ly) structural/reason", "surprising", "surprisingly", "natural(ly) enough"],
    "SIGNPOST": ["having established/shown/seen", "we now turn", "we turn now", "in this section/subsection we", "the rest/remainder of this", "before proceeding/turning", "as we shall/will see"],
    "VAGUEATTR": ["it is well known", "well known that", "standard result(s)", "it is classical/standard that", "one can show", "it can be shown", "as is (well )known"],
}
MARKS = {"emdash": "—", "semicolon": ";", "colon": ":", "parenthesis": "("}


def _phrase(phrase: str) -> str:
    """The pattern of a phrase."""
    out = []
    for k, word in enumerate(phrase.split(" ") if "(" not in phrase else re.split(r" (?![^(]*\))", phrase)):
        if word.startswith("..."):
            out.append(r"\s+(?:\w+[\s,]+){0," + word[3:] + "}?")
            continue
        word = re.sub(r"\(([^)]*)\)", lambda m: "(?:" + m.group(1).replace(" ", r"\s+") + ")?", word)
        word = re.sub(r"[\w-]+(?:/[\w-]+)+", lambda m: "(?:" + m.group().replace("/", "|") + ")", word)
        glued = not out or out[-1].endswith("}?") or word == ","
        out.append(("" if glued else r"\s*" if word[0] == "[" or out[-1][-1] == "]" else " ") + word)
    return "".join(out)


#: The expression that counts each feature in lower-case text.
FAMILIES = {
    **{name: re.escape(mark) for name, mark in MARKS.items()},
    **{name: r"\b(?:" + "|".join(_phrase(p.lower()) + ("" if p.endswith(",") else r"\b") for p in phrases) + ")" for name, phrases in PHRASES.items()},
}


def group(depth: int) -> str:
    """The pattern of a braced group that holds groups down to ``depth``."""
    return r"\{(?:[^{}]" + (f"|{group(depth - 1)}" if depth else "") + r")*\}"


def _any(names) -> str:
    return "(?:" + "|".join(names) + ")"


#: Groups of a note may be nested twice.
NOTE = r"\\emph" + group(2)
GAP = r"(?:\s|" + "|".join(rf"\\{n}\b" for n in SPACE_COMMANDS) + ")*"
STATUS_TAG = rf"\\{_any(STATUS_COMMANDS)}\b"
COMMENT = r"(?md)(?<!\\)%.*$"
_NOUN = r"\b" + _any(n for pair in sorted(REFERENCE_NOUNS.items()) for n in reversed(pair)) + r"~?\s*(?=\\ref\{)"


def sha12(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(12))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT, "")


def statement(text: Column) -> Column:
    """The mathematical text of an environment, for hashing: no comments, metadata, status with its note, or flags."""
    metadata = rf"\\{_any(METADATA_COMMANDS)}\{{[^}}]*\}}"
    for pattern in (COMMENT, metadata, f"{STATUS_TAG}{GAP}(?:{NOTE})?", rf"\\{_any((*STATUS_COMMANDS, *FLAG_COMMANDS))}\b"):
        text = F.regexp_replace(text, pattern, "")
    return collapsed(text)


def shared_statement(text: Column) -> Column:
    """The part of a statement that two sources share: up to the status tag, references unnamed."""
    return F.regexp_replace(statement(F.regexp_replace(text, f"(?s){STATUS_TAG}.*$", "")), _NOUN, "")


def shared_proof(text: Column) -> Column:
    plain = F.regexp_replace(statement(text), rf"\\{_any(('autoref', 'cref', 'Cref'))}\*?\{{", r"\\ref{")
    return F.regexp_replace(plain, _NOUN, "")


def rendered(text: Column) -> Column:
    """The source of a statement or proof for rendering: as ``statement``, but references to the ledger
    outside of the status line are named in words."""
    text = F.regexp_replace(text, COMMENT, "")
    text = F.regexp_replace(text, STATUS_TAG + r"(?:\s|" + "|".join(rf"\\{n}\b" for n in SPACE_COMMANDS) + rf"|\\ledger\{{[^}}]*\}})*(?:{NOTE})?", "")
    text = F.regexp_replace(text, r"\\ledger\{([^:}]*):([^}]*)\}", "ledger $2 of $1")
    text = F.regexp_replace(text, r"\\ledger\{([^}]*)\}", "ledger $1")
    for pattern in (rf"\\{_any(c for c in METADATA_COMMANDS if c != 'ledger')}\{{[^}}]*\}}", rf"\\{_any((*STATUS_COMMANDS, *FLAG_COMMANDS))}\b"):
        text = F.regexp_replace(text, pattern, "")
    return collapsed(text)


def reference_labels(text: Column) -> Column:
    """Labels that a text cites with any reference command, each once, in order."""
    cited = F.regexp_extract_all(without_comments(text), F.lit(rf"\\{_any(REFERENCE_COMMANDS)}\*?\{{([^}}]*)\}}"), 1)
    return F.array_distinct(F.filter(F.transform(F.split(F.array_join(cited, ","), ","), lambda x: F.trim(x)), lambda x: x != ""))


def words(text: Column) -> Column:
    """Words of two letters or more; apostrophes and hyphens belong to a word."""
    return F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ…'’\\-]+"), 0)


def feature_counts(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(F.lower(text), F.lit(pattern)) for name, pattern in FAMILIES.items()}


def per_thousand(n: Column, of: Column) -> Column:
    return F.when(of > 0, 1000.0 * n / of).otherwise(0.0)


#: Fixed value: occurrences below which a rate is no finding.
LEAST_COUNT = 5


def verdict(n: Column, rate: Column, author: Column, genre: Column, factor: float = 2.0, supported: tuple[bool, bool] = (True, True)) -> Column:
    """How a rate compares with two baselines: ``BOTH``, ``voice`` (author), ``genre`` or nothing.

    A baseline of zero is exceeded by any rate; one that does not support the figure by none.
    """
    over = lambda base, known: F.lit(known) & F.when(base <= 0, rate > 0).otherwise(rate / base >= factor)
    a, g = over(author, supported[0]), over(genre, supported[1])
    return F.when(n < LEAST_COUNT, "").when(a & g, "BOTH").when(a, "voice").when(g, "genre").otherwise("")


def ratio(rate: Column, base: Column) -> Column:
    """A rate over its baseline as text: ``new`` without a baseline, nothing to tell as ``-``."""
    return F.when(base <= 0, F.when(rate > 0, "new").otherwise("-")).when(rate / base > 99, ">99x").otherwise(F.format_string("%.1fx", rate / base))


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters."""
    return F.floor(F.length(text) / 4)


def control_chars(text: Column) -> Column:
    """Characters under a blank other than line feeds, and returns without a line feed after them."""
    return F.regexp_count(text, F.lit(r"[\x00-\x09\x0B\x0C\x0E-\x1F]|\r(?!\n)"))


def alpha_normal(text: Column) -> Column:
    """Tokens of a declaration with one-letter names made equal."""
    parts = F.regexp_extract_all(text, F.lit(r"(?U)[\w'.]+|\S"), 0)
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike("^[a-z]$"), "ν").otherwise(t)), " ")


def version(tag: Column) -> Column:
    """``vX.Y.Z`` as a comparable struct, missing parts 0; null for anything else."""
    part = lambda k: F.regexp_extract(tag, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?$", k)
    number = lambda k: F.when(part(k) == "", F.lit(0)).otherwise(part(k).try_cast("int"))
    return F.when(part(1) != "", F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch")))


def is_pinned(ref: Column) -> Column:
    """Whether a revision is fixed: a full version or a full digest."""
    return ref.rlike(r"^v\d+\.\d+\.\d+$|^[0-9a-f]{40}$")


def revision_matches(wanted: Column, named: Column, sha: Column) -> Column:
    return (wanted == named) | ((F.length(wanted) >= 7) & wanted.rlike("^[0-9a-f]+$") & F.startswith(sha, wanted))


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)
