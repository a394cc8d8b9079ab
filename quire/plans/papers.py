"""Checks of papers: inputs in document order, items, tags, pointers, headings, abstracts, unmarked statements.

Each text is parsed once, where it lies, into a few rows of events; the checks join, count or
carry over these rows. Findings have the columns of ``rules``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.operators import graph
from quire.plans.rules import _finding
from quire.session import cut
from quire.sources import statements
from quire.sources.texts import parsed

#: Bounds of an abstract in words, and the characters around a pointer that are searched.
ABSTRACT_WORDS, POINTER_WINDOW = (150, 250), 120
#: What a paper has to declare in a heading.
DECLARATIONS = (
    ("author contributions", r"author\s+contribution"),
    ("competing interests", r"competing\s+interest|conflicts?\s+of\s+interest|declarations?\s+of\s+interest"),
    ("data availability", r"data\s+availability|code\s+availability|availability\s+of\s+(?:data|code)"),
    ("funding", r"funding|financial\s+support"),
)
#: Abbreviated names of results and parts, commands that include a file, headings.
POINTED = ("Thm", "Prop", "Lem", "Cor", "Def", "Defn", "Sec", "Ch", "Eq", "Eqn")
INCLUDES = ("input", "include", "subfile")
HEADINGS = ("chapter", "section", "subsection", "subsubsection", "paragraph", "bmhead")
#: Theorem-like environments that claim nothing, and the words of an opt-out.
NO_CLAIMS, OPT_OUT = ("example", "remark", "proof"), "no blueprint node"
#: Environments that papers may declare; more is an error, since their names form one pattern.
MOST_ENVIRONMENTS = 10_000

_INCLUDE = re.compile(r"\\(?:" + "|".join(INCLUDES) + r")\{([^}]+)\}")
_CITE = re.compile(r"\\[A-Za-z]*[Cc]ite[A-Za-z]*\*?(?:\[[^\]]*\])*\{[^}]*\}")
_REF = re.compile(r"\\(?:" + "|".join(fn.REFERENCE_COMMANDS) + r")\*?\{([^}]*)\}")
_ITEM_NO = re.compile(r"(?:\s|~|\\[,;:!])*\(\s*(\d+|[ivxIVX]+)\s*\)")
_POINTER = re.compile(r"§|\\S(?![A-Za-z])|\b(?:" + "|".join(POINTED) + r")\.")
_ROMAN = {"i": 1, "v": 5, "x": 10}


def blanked(text: str) -> str:
    """The text with its comments as blanks, every place and line break kept."""
    out = []
    for line in text.splitlines(keepends=True):
        at = 0
        while at < len(line) and line[at] != "%":
            at += 2 if line[at] == "\\" else 1
        body = line.rstrip("\r\n")
        out.append(line if at >= len(body) else body[:at] + " " * (len(body) - at) + line[len(body) :])
    return "".join(out)


def item_number(said: str) -> int:
    """An item number in arabic or lower roman digits up to ten; 0 for anything else."""
    if said.isdigit():
        return int(said)
    values = [_ROMAN.get(c, 0) for c in said.lower()]
    n = sum(-v if v < max(values[k + 1 :], default=0) else v for k, v in enumerate(values))
    return n if said.lower() == _roman(n) else 0


def _roman(n: int) -> str:
    return ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")[n] if 0 <= n <= 10 else ""


def abstract_words(tex: str) -> int:
    """Words of an abstract; a formula is one."""
    plain = re.sub(r"\$\$?.*?\$\$?", " x ", tex, flags=re.S)
    plain = re.sub(r"[{}~\\$]", " ", re.sub(r"\\[A-Za-z]+\*?", " ", plain))
    return sum(any(c.isalnum() for c in w) for w in plain.split())


# -- inputs ------------------------------------------------------------------------------


def segments_of(text: str) -> list[tuple]:
    """(pos, begin, end, target): the runs of a text between its includes, and what is included after each."""
    plain = blanked(text)
    out, at = [], 0
    for m in _INCLUDE.finditer(plain):
        out.append((len(out), at, m.start(), m.group(1).strip()))
        at = m.end()
    return [*out, (len(out), at, len(text), None)]


def _resolved(names: DataFrame, texts: DataFrame) -> DataFrame:
    """``path, pos, target``: the file that an include names, as it is or with the ending of sources, beside the file or at the root."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    tried = F.array(*[F.concat(base, F.col("name"), F.lit(end)) for base in (folder, F.lit("")) for end in ("", ".tex")])
    known = texts.select(F.col("path").alias("target")).distinct()
    found = names.select("path", "pos", F.posexplode(tried).alias("try", "target")).join(known, "target")
    return found.groupBy("path", "pos").agg(F.min_by("target", "try").alias("target"))


def reading_order(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, place, path, begin, end``: the runs of all files in the order in which the document of a root reads them.

    Files that are on their own way from the root are not entered again; names that no file has
    are passed over.
    """
    runs = cut(parsed(texts, segments_of, "pos int, begin int, end int, target string"))
    includes = _resolved(runs.filter("target IS NOT NULL").select("path", "pos", F.col("target").alias("name")), texts)
    walked = graph.splice(includes.select(F.col("path").alias("src"), F.col("target").alias("dst"), (2 * F.col("pos") + 1).alias("pos")), roots)
    every = walked.select("root", F.col("node").alias("path"), "place").join(runs.select("path", "pos", "begin", "end"), "path")
    # a run has an even number, what is included after it the odd one that follows
    return every.select("root", F.concat("place", F.array((2 * F.col("pos")).cast("bigint"))).alias("place"), "path", "begin", "end")


def expanded(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """``path, text``: each root with everything that it includes put in place. A row holds one document."""
    order = reading_order(texts, roots).join(texts.select("path", "text"), "path")
    piece = F.struct("place", F.substring("text", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("t"))
    return order.groupBy(F.col("root").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "").alias("text"))


def first_reached(order: DataFrame) -> DataFrame:
    """``root, path, place`` of every file, in the order in which the documents first reach them."""
    return order.groupBy("root", "path").agg(F.min("place").alias("place"))


# -- checks ------------------------------------------------------------------------------


def _events(text: str) -> list[tuple]:
    """(kind, pos, line, value, number) of what the checks look at."""
    plain = blanked(text)
    starts = [0, *[m.end() for m in re.finditer("\n", plain)]]
    out: list[tuple] = []

    def add(kind: str, at: int, value: str | None = None, number: int | None = None) -> None:
        import bisect

        out.append((kind, at, bisect.bisect_right(starts, at), value, number))

    near = sorted([m.span() for m in _CITE.finditer(plain)] + [m.span() for m in _REF.finditer(plain)])
    ends = [b for _, b in near]
    for m in _REF.finditer(plain):
        item = _ITEM_NO.match(plain, m.end())
        if item and "#" not in m.group(1):
            add("item", m.start(), m.group(1).strip(), item_number(item.group(1)))
    for m in _POINTER.finditer(plain):
        import bisect

        lo, hi = max(0, m.start() - POINTER_WINDOW), m.end() + POINTER_WINDOW
        k = bisect.bisect_left(ends, lo)
        while k < len(near) and near[k][0] < lo:  # begins before the frame
            k += 1
        if k == len(near) or near[k][1] > hi:
            add("point", m.start(), m.group())
    for m in re.finditer(r"\\(?:(section)\{|(appendix)\b|tag\*?\{([^}]*)\})", plain):
        add(m.group(1) or m.group(2) or "tag", m.start(), m.group(3).strip() if m.group(3) is not None else None)
    for m in re.finditer(r"\\(?:" + "|".join(HEADINGS) + r")\*?\{([^}]*)\}", plain):
        add("heading", m.start(), m.group(1))
    for m in re.finditer(r"\\begin\{abstract\}(.*?)\\end\{abstract\}", plain, re.S):
        add("abstract", m.start(), None, abstract_words(m.group(1)))
    for begin, _, env, _, body, _, _, _ in statements.statements_at(plain):
        label = re.search(r"\\label\{([^}]+)\}", body)
        if label:
            add("statement", begin, label.group(1).strip(), len(re.findall(r"\\item\b", body)))
    return out


EVENT = "kind string, pos int, line int, value string, number int"


def events(texts: DataFrame) -> DataFrame:
    return parsed(texts, _events, EVENT)


def _place(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.concat_ws(":", "path", F.col("line").cast("string")))


def items(found: DataFrame, modules: DataFrame) -> DataFrame:
    """References to an item that the statement does not have.

    ``modules``: path, module (null: of none). A label means the statement of the own module, else
    the first of any; statements without items are passed over.
    """
    placed = found.join(modules, "path", "left")
    stated = placed.filter("kind = 'statement'").select(F.col("value").alias("label"), "module", "path", "pos", F.col("number").alias("has"))
    first = lambda keys: stated.groupBy(*keys).agg(F.min_by("has", F.struct("path", "pos")).alias("has"))
    own = first(["module", "label"]).filter("module IS NOT NULL").withColumnRenamed("has", "own_has")
    asked = _place(placed.filter("kind = 'item' AND number > 0").withColumnRenamed("value", "label"))
    j = asked.join(own, ["module", "label"], "left").join(first(["label"]), "label", "left")
    has = F.coalesce("own_has", "has")
    wrong = j.filter((has > 0) & (F.col("number") > has))
    return _finding(wrong, "item", "fatal", "at", F.concat_ws(" ", "label", F.lit("has"), has.cast("string"), F.lit("items, not"), F.col("number").cast("string")))


def tags(found: DataFrame, order: DataFrame) -> DataFrame:
    """Hand-written numbers ``N.M`` that stand in another section than N, over the reading order of each document.

    Numbers whose N is no section of the document are left alone.
    """
    marks = found.filter("kind IN ('section', 'appendix', 'tag')")
    placed = order.join(marks, "path").filter("pos >= begin AND pos < end").withColumn("where", F.concat("place", F.array(F.col("pos").cast("bigint"))))
    so_far = Window.partitionBy("root").orderBy("where").rowsBetween(Window.unboundedPreceding, 0)
    ahead = placed.withColumn("in_appendix", F.max((F.col("kind") == "appendix").cast("int")).over(so_far))
    w = Window.partitionBy("root", "in_appendix").orderBy("where").rowsBetween(Window.unboundedPreceding, 0)
    counted = ahead.withColumn("section", F.sum((F.col("kind") == "section").cast("int")).over(w))
    name = lambda n: F.when(F.col("in_appendix") == 1, F.char(n + 64)).otherwise(n.cast("string"))
    known = counted.filter("kind = 'section'").select("root", name(F.col("section")).alias("id")).distinct()
    said = F.regexp_extract("value", r"^\(?\s*(\d+|[A-Z])\s*\.\s*\d+\s*\)?$", 1)
    tagged = _place(counted.filter("kind = 'tag' AND section > 0").withColumn("id", said)).join(known, ["root", "id"], "left_semi")
    wrong = tagged.filter(F.col("id") != name(F.col("section")))
    return _finding(wrong, "tag", "fatal", "at", F.concat_ws(" ", "value", F.lit("stands in"), name(F.col("section"))))


def pointers(found: DataFrame) -> DataFrame:
    """Bare pointers without a citation or reference near."""
    return _finding(_place(found.filter("kind = 'point'")), "point", "advisory", "at", F.col("value"))


def declarations(found: DataFrame, modules: DataFrame) -> DataFrame:
    """What no heading of a module declares."""
    headings = found.filter("kind = 'heading'").join(modules.filter("module IS NOT NULL"), "path")
    said = headings.groupBy("module").agg(*[F.bool_or(F.col("value").rlike(f"(?i){p}")).alias(f"d{k}") for k, (_, p) in enumerate(DECLARATIONS)])
    every = modules.filter("module IS NOT NULL").select("module").distinct().join(said, "module", "left")
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"d{k}"), F.lit(False)), F.lit(name)) for k, (name, _) in enumerate(DECLARATIONS)]))
    return _finding(every.select("module", F.explode(missing).alias("name")), "decl", "advisory", "module", F.col("name"))


def abstracts(found: DataFrame, modules: DataFrame, order: DataFrame) -> DataFrame:
    """Modules whose first abstract, in reading order, is missing or out of bounds. ``order``: of ``first_reached``, its root the module's."""
    first = found.filter("kind = 'abstract'").join(modules, "path").join(order.select("path", "place").groupBy("path").agg(F.min("place").alias("place")), "path", "left")
    first = first.groupBy("module").agg(F.min_by("number", F.struct("place", "path", "pos")).alias("n"))
    j = modules.filter("module IS NOT NULL").select("module").distinct().join(first, "module", "left")
    bad = j.filter(F.col("n").isNull() | ~F.col("n").between(*ABSTRACT_WORDS))
    return _finding(bad, "abstr", "advisory", "module", F.coalesce(F.concat(F.col("n").cast("string"), F.lit(" words")), F.lit("no abstract")))


def lint(texts: DataFrame, modules: DataFrame, roots: DataFrame) -> DataFrame:
    """All findings of these checks. ``roots``: column node, the main document of each module."""
    found = cut(events(texts))
    order = cut(reading_order(texts, roots))
    parts = [items(found, modules), tags(found, order), pointers(found), declarations(found, modules), abstracts(found, modules, first_reached(order))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


# -- statements without a mark -----------------------------------------------------------


def _declared(text: str) -> list[tuple]:
    """Environments that a file declares as claims; a style holds until the next one."""
    style, out = "plain", []
    for line in text.split("\n"):
        for m in re.finditer(r"\\(theoremstyle|newtheorem)\*?\{(\w+)\}", line.split("%", 1)[0]):
            if m.group(1) == "theoremstyle":
                style = m.group(2)
            elif style != "remark" and m.group(2) not in NO_CLAIMS:
                out.append((m.group(2),))
    return out


def declared_environments(texts: DataFrame, known: tuple[str, ...] = statements.ENVIRONMENTS) -> DataFrame:
    """``env``: the environments of claims, those of the configuration and those that papers declare."""
    fixed = texts.sparkSession.createDataFrame([(e,) for e in known], "env string")
    return parsed(texts, _declared, "env string").select("env").unionByName(fixed).distinct()


def unmarked(texts: DataFrame, environments: DataFrame) -> DataFrame:
    """``path, line, env, label`` of statements over which neither a mark nor an opt-out stands.

    A mark covers the next statement only. What lies within another statement or in a comment is
    none. The names of environments are gathered: their number is checked.
    """
    names = [r.env for r in environments.limit(MOST_ENVIRONMENTS + 1).collect()]
    if len(names) > MOST_ENVIRONMENTS:
        raise ValueError(f"more than {MOST_ENVIRONMENTS} environments")

    def run(text: str) -> list[tuple]:
        opening = re.compile(r"\\begin\{(" + "|".join(map(re.escape, sorted(names))) + r")\}")
        plain = blanked(text)
        marks = [start for start, _, _ in statements._marks(text)]
        marks += [m.start() for m in re.finditer(rf"%[ \t]*{OPT_OUT}\b[^\n]*?\S", text) if re.sub(r"^[ \t]*[:—-]?[ \t]*", "", text[m.start() : text.find("\n", m.start()) if "\n" in text[m.start() :] else None].split(OPT_OUT, 1)[1])]
        out, done = [], 0
        for m in opening.finditer(plain):
            if m.start() < done:
                continue
            close = "\\end{" + m.group(1) + "}"
            end = text.find(close, m.end())
            before, done = done, end + len(close) if end >= 0 else m.end()
            if any(before <= k < m.start() for k in marks):
                continue
            label = re.search(r"\\label\{([^}]+)\}", text[m.end() : done])
            out.append((text.count("\n", 0, m.start()) + 1, m.group(1), label.group(1) if label else None))
        return out

    return parsed(texts, run, "line int, env string, label string")


def unmarked_findings(texts: DataFrame) -> DataFrame:
    found = unmarked(texts, declared_environments(texts))
    return _finding(_place(found), "node", "advisory", "at", F.concat_ws(" ", "env", F.coalesce("label", F.lit("(no label)"))))
