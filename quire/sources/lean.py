"""Declarations of a proof language: namespaces, statements, proofs, axiom pins, imports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.texts import parsed

KINDS = ("theorem", "lemma", "def", "abbrev", "structure", "class", "inductive", "instance", "axiom", "opaque")
_HEAD = re.compile(
    r"^(?P<mods>(?:@\[[^\]]*\]\s*|(?:private|protected|noncomputable|unsafe|partial|scoped|local)\s+)*)"
    r"(?P<kind>" + "|".join(KINDS) + r")\b[ \t]*(?P<name>[^\s:({\[⦃:=]+)?", re.M
)
_SCOPE = re.compile(r"^(namespace|section|end)\b[ \t]*([\w.'«»]*)", re.M)


def without_comments(text: str) -> str:
    """The text with comments blanked; block comments nest, strings are kept, lines stay."""
    out, at, depth = [], 0, 0
    while at < len(text):
        two = text[at : at + 2]
        if two == "/-":
            depth += 1
            at += 2
            out.append("  ")
        elif two == "-/" and depth:
            depth -= 1
            at += 2
            out.append("  ")
        elif depth:
            out.append("\n" if text[at] == "\n" else " ")
            at += 1
        elif two == "--":
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            out.append(" " * (end - at))
            at = end
        elif text[at] == '"':
            end = at + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            out.append(text[at : end + 1])
            at = end + 1
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def split_statement(text: str) -> tuple[str, str]:
    """Statement and proof: divided at ``:=`` or ``where`` outside all brackets."""
    depth = 0
    for m in re.finditer(r"[(\[{⟨⦃]|[)\]}⟩⦄]|:=|\bwhere\b|^\s*\|", text, re.M):
        word = m.group()
        if word in "([{⟨⦃":
            depth += 1
        elif word in ")]}⟩⦄":
            depth -= 1
        elif depth <= 0:
            return text[: m.start()].strip(), text[m.end() :].strip()
    return text.strip(), ""


DECL = "pos int, line int, kind string, mods string, name string, ns string, fullname string, stmt string, proof string, src_lines int, doc string"


def declarations_of(text: str) -> list[tuple]:
    plain = without_comments(text)
    events = sorted([(m.start(), 0, m) for m in _SCOPE.finditer(plain)] + [(m.start(), 1, m) for m in _HEAD.finditer(plain)], key=lambda e: e[:2])
    stack: list[tuple[str, str]] = []
    out = []
    for k, (start, is_head, m) in enumerate(events):
        if not is_head:
            word, name = m.groups()
            if word == "end":
                while stack and name and stack[-1][1] != name:
                    stack.pop()
                if stack:
                    stack.pop()
            else:
                stack.append((word, name))
            continue
        end = events[k + 1][0] if k + 1 < len(events) else len(plain)
        ns = ".".join(name for word, name in stack if word == "namespace" and name)
        name = m.group("name") or ""
        block = plain[m.end() : end]
        stmt, proof = split_statement(block)
        before = text[:start].rstrip()
        doc = None
        if before.endswith("-/") and (at := before.rfind("/--")) >= 0 and "-/" not in before[at:-2]:
            doc = before[at + 3 : -2].strip()
        full = name[7:] if name.startswith("_root_.") else ".".join(p for p in (ns, name) if p)
        out.append((len(out), plain.count("\n", 0, start) + 1, m.group("kind"), " ".join(m.group("mods").split()), name, ns, full, " ".join(stmt.split()), " ".join(proof.split()), len(plain[start:end].rstrip().split("\n")), doc))
    return out


def declarations(texts: DataFrame) -> DataFrame:
    return parsed(texts, declarations_of, DECL)


def imports(texts: DataFrame) -> DataFrame:
    """``src, dst, pos``: modules a module imports, in order."""
    module = F.regexp_replace(F.regexp_replace("path", r"\.lean$", ""), "/", ".")
    return texts.select(module.alias("src"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^import[ \t]+([\w.]+)"), 1)).alias("pos", "dst")).select("src", "dst", "pos")


PIN = "decl string, line int, guarded boolean, axioms array<string>"


def pins_of(text: str) -> list[tuple]:
    """Printed axiom lists that a message guard right before them fixes; null where the guard is not readable."""
    out = []
    for m in re.finditer(r"^[ \t]*(?:#guard_msgs[^\n]*?\bin\s+)?#print axioms[ \t]+([\w.'«»]+)", text, re.M):
        before = text[: m.start()].rstrip()
        guard = "#guard_msgs" in m.group(0)
        axioms = None
        if guard and before.endswith("-/") and (at := before.rfind("/--")) >= 0:
            said = before[at:]
            listed = re.search(r"depends on axioms:\s*\[([^\]]*)\]", said)
            axioms = [a.strip() for a in listed.group(1).split(",") if a.strip()] if listed else [] if "does not depend on any axioms" in said else None
        out.append((m.group(1), text.count("\n", 0, m.start(1)) + 1, guard, axioms))
    return out


def pins(texts: DataFrame) -> DataFrame:
    return parsed(texts, pins_of, PIN)
