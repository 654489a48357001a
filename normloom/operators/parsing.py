"""Legal texts to citable sections: line grammars for Vietnamese and Malaysian law, provision trees and layout blocks.

A grammar turns a text into an outline, a flat list of nodes in reading order; only nodes with text of their own become
rows. Texts are parsed whole, one per row, in Arrow batches; a text that fails to parse gives an error row, never an error.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.functions.text import html_text
from normloom.plans.session import spread


@dataclass
class Node:
    kind: str
    level: int
    path: str
    label: str
    headings: tuple[str, ...]
    heading: str = ""
    body: list[str] = field(default_factory=list)

    def title(self) -> str:
        return f"{self.label} — {self.heading}" if self.heading else self.label


class Outline:
    """Nodes in reading order and the chain of open ones. number_repeats tells how a repeated path is told apart."""

    def __init__(self, repeat: Callable[[str, int], str]):
        self.nodes: list[Node] = []
        self.open: list[Node] = []
        self.used: Counter[str] = Counter()
        self.repeat = repeat

    def add(self, kind: str, level: int, segment: str, label: str, heading: str = "") -> Node:
        """Opens a node below the nearest open one of a lower level."""
        while self.open and self.open[-1].level >= level:
            self.open.pop()
        above = self.open[-1] if self.open else None
        path = f"{above.path}/{segment}" if above else segment
        self.used[path] += 1
        if self.used[path] > 1:
            path = self.repeat(path, self.used[path])
        node = Node(kind, level, path, label, (*above.headings, above.title()) if above else (), heading)
        self.nodes.append(node)
        self.open.append(node)
        return node

    def text(self, line: str) -> None:
        """Text before the first node is dropped."""
        if self.open:
            self.open[-1].body.append(line)

    def has(self, *kinds: str) -> bool:
        return any(n.kind in kinds for n in self.open)

    def rows(self) -> list[tuple[str, str, str, str]]:
        """(kind, citation_path, heading_path, text) of the nodes that have text or a heading of their own and no node below."""
        out = []
        for i, n in enumerate(self.nodes):
            leaf = i + 1 == len(self.nodes) or self.nodes[i + 1].level <= n.level
            body = "\n".join(n.body).strip()
            if body or leaf and n.heading:
                out.append((n.kind, n.path, " > ".join((*n.headings, n.title())), body or n.heading))
        return out


# --- Vietnamese law -------------------------------------------------------------------------------------------------------

#: The order of letters of points; đ follows d.
POINTS = "abcdđeghiklmnopqrstuvxy"
_SPACES = str.maketrans({" ": " ", " ": " ", " ": " "})
_PART = re.compile(r"^Phần\s+(?:thứ\s+)?([IVXLC]+|[a-zà-ỹ]+)(?![\w])[.:\s–-]*(.*)$")
_CHAPTER = re.compile(r"^(?:Chương|CHƯƠNG)\s+([IVXLC]+|[0-9]+)(?![\w])[.:\s–-]*(.*)$")
_SECTION = re.compile(r"^(?:Mục|MỤC)\s+([IVXLC]+|[0-9]+)(?![\w])[.:\s–-]*(.*)$")
_ARTICLE = re.compile(r"^Điều\s+([0-9]+[a-z]?)(?![0-9A-Za-zđà-ỹ])\s*([.:]?)\s*(.*)$")
#: An appendix' own line: its label alone in any case, or all in capitals with the title behind.
_APPENDIX = re.compile(r"^(?i:phụ\s+lục)(?i:\s+(?:số\s+)?(\d+[a-zđ]?|[ivxlc]+[a-zđ]?))?\s*[.:]?$|^PHỤ\s+LỤC(?:\s+(?:SỐ\s+)?(\d+[A-ZĐ]?|[IVXLC]+[A-ZĐ]?)(?!\w))?[\s.:–-]+(\S.{2,})$")
_BOLD = re.compile(r"^(\*\*|__|\*|_)(.+)\1$")


@dataclass(frozen=True)
class Label:
    """The label that a line begins with: its letters or digits, the sign that closes it, whether a bracket opens it, and the rest."""

    mark: str
    close: str
    bracket: bool
    rest: str

    def numbers(self) -> list[str]:
        """['1', '2'] of '1.2'; [] of anything else."""
        parts = self.mark.split(".")
        return parts if all(p.isascii() and p.isdigit() for p in parts) else []


_ROMANS = frozenset("IVXLC")


def label_of(line: str) -> Label | None:
    """The label of a line: letters and digits (joined by single stops) up to a closing . ) / or -, then white space or the end, or a
    bracketed one; None for a line that begins otherwise."""
    at = int(line[:1] == "(")
    start = at
    while at < len(line) and (line[at].isalnum() or line[at] == "." and at > start and line[at - 1] != "." and line[at + 1 : at + 2].isdigit()):
        at += 1
    mark, gap = line[start:at], at
    while not start and gap < len(line) and line[gap] == " " and mark.isupper():  # 'IV - Heading'
        gap += 1
    close, rest = line[gap : gap + 1], line[gap + 1 :]
    closed = close == ")" if start else close in (".", ")", "/", "-") and (not rest or rest[0].isspace())
    return Label(mark, close, bool(start), rest.strip()) if mark and closed else None


def _plain(line: str) -> tuple[str, bool]:
    """The line without emphasis around all of it, and whether it had any."""
    bold = False
    while m := _BOLD.match(line):
        line, bold = m[2].strip(), True
    return line, bold


def parse_vn(text: str | None) -> list[tuple[str, str, str, str]]:
    """Rows of a Vietnamese law text: part, chapter, section, article, clause, point and appendix.

    Quoted amendments stay text of the clause that quotes them. 'Điều 5 của ...' in running text is no heading. Clauses open
    only below an article, a clause or an old outline heading; a bold '1. Heading' where no article is open is an article
    whose label was lost. A heading line without a title takes the next line of text as its title. Text before the
    first heading is dropped. Without any heading: a numbered outline of two lines or more, else the whole text if it has
    300 characters and 4 lines, else nothing.
    """
    out, quoted, want_title = Outline(lambda path, n: f"{path}~{n}"), 0, None
    lines = [_plain(raw.translate(_SPACES).strip()) for raw in (text or "").splitlines()]
    for line, bold in lines:
        if not line:
            continue
        inside = quoted > 0 or line[0] in "“\""
        quoted = max(0, quoted + line.count("“") - line.count("”"))
        node = None if inside else _vn_heading(out, line, bold)
        if node is not None:
            want_title = node if node.kind in ("part", "chapter", "section", "article", "appendix") and not node.heading else None
        elif want_title is not None and not inside:
            want_title.heading, want_title = line, None
        else:
            want_title = None
            out.text(line)
    return out.rows() if out.nodes else _vn_fallback([line for line, _ in lines if line])


def _vn_heading(out: Outline, line: str, bold: bool) -> Node | None:
    if m := _PART.match(line):
        return out.add("part", 1, f"phan-{m[1].lower()}", f"Phần {m[1]}", m[2])
    if m := _CHAPTER.match(line):
        return out.add("chapter", 2, f"chuong-{m[1].lower()}", f"Chương {m[1]}", m[2])
    if m := _SECTION.match(line):
        return out.add("section", 3, f"muc-{m[1].lower()}", f"Mục {m[1]}", m[2])
    if (m := _APPENDIX.match(line)) and (m[3] or "").upper() == (m[3] or ""):
        no = (m[1] or m[2] or "").lower()
        return out.add("appendix", 1, f"phu-luc-{no}" if no else "phu-luc", f"Phụ lục {no}".strip(), m[3] or "")
    if (m := _ARTICLE.match(line)) and (m[2] or not m[3]):
        return out.add("article", 4, f"dieu-{m[1]}", f"Điều {m[1]}", m[3])
    label = label_of(line)
    if label is None or label.bracket or not label.rest:
        return None
    mark = label.mark
    is_clause = label.close == "." and len(label.numbers()) == 1
    if is_clause and bold and not out.has("article"):
        return out.add("article", 4, f"dieu-{mark}", f"Điều {mark}", label.rest)
    below = out.has("article", "clause", "outline")
    if below and is_clause:
        return _with_text(out.add("clause", 5, f"khoan-{mark}", f"Khoản {mark}"), label.rest)
    if below and label.close in ")./" and len(mark) == 1 and mark in POINTS:
        return _with_text(out.add("point", 6, f"diem-{'dd' if mark == 'đ' else mark}", f"Điểm {mark}"), label.rest)
    roman, letter = set(mark) <= _ROMANS, len(mark) == 1 and mark in "ABCDEFGHIJKLMNOPQRSTUVWXYZĐ"
    if not out.has("article", "appendix") and label.close in ".-" and (roman or letter):
        return out.add("outline", 3 if len(mark) > 1 or mark in "IVX" else 4, f"muc-{mark.lower()}", mark, label.rest)
    return None


def _with_text(node: Node, text: str) -> Node:
    node.body.append(text)
    return node


def _vn_fallback(lines: list[str]) -> list[tuple[str, str, str, str]]:
    labels = [label_of(line) for line in lines]
    numbered = [x if x and not x.bracket and x.close in ".)" and x.numbers() and x.rest else None for x in labels]
    if sum(x is not None for x in numbered) >= 2:
        out = Outline(lambda path, n: f"{path}~{n}")
        for line, x in zip(lines, numbered, strict=True):
            if x:
                _with_text(out.add("clause", 4 + len(x.numbers()), "khoan-" + x.numbers()[-1], f"Khoản {x.mark}"), x.rest)
            else:
                out.text(line)
        return out.rows()
    whole = "\n".join(lines)
    return [("text", "toan-van", "Toàn văn", whole)] if len(whole) >= 300 and len(lines) >= 4 else []


# --- Malaysian law --------------------------------------------------------------------------------------------------------

_ENACTED = re.compile(r"enacted\s+by", re.I)
_NOISE = re.compile(r"^(?:\d{1,4}|laws? of malaysia(?:\s+act\s+\d+)?|act\s+\d+|page\s+\d+(?:\s+of\s+\d+)?)$", re.I)
_MY_PART = re.compile(r"^PART\s+([IVXLC]+|\d+)\b[.:\s–-]*(.*)$", re.I)
_MY_CHAPTER = re.compile(r"^(CHAPTER|DIVISION)\s+(\d+|[IVXLC]+)\b[.:\s–-]*(.*)$", re.I)
_MY_SCHEDULE = re.compile(r"^((?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH)\s+)?SCHEDULE(?:\s+(\d+|[IVXLC]+))?\b[.:\s–-]*(.*)$")
_MY_SECTION = re.compile(r"^(\d+)([A-Z]*)\.\s*(.*)$")
_ROMAN = re.compile(r"^(?=[ivx])(x{0,3})(ix|iv|v?i{0,3})$")


def parse_my(text: str | None) -> list[tuple[str, str, str, str]]:
    """Rows of a Malaysian act: part, chapter, section, subsection, paragraph, subparagraph and schedule.

    All before the enacting line is dropped, as are page numbers and running headers. Section numbers must continue the run
    from 1, or repeat its last number with a letter, so the numbering inside schedules and references are no sections.
    '(i)' is a subparagraph unless it continues the alphabet of the paragraphs. A schedule ends the sections. A text
    without structure is one row; an empty one none.
    """
    lines = [line.strip() for line in (text or "").splitlines()]
    start = next((i + 1 for i, line in enumerate(lines) if _ENACTED.search(line)), 0)
    out, last, schedule, letter, title = Outline(lambda path, n: f"{path}-{n}"), 0, False, "", None
    for line in lines[start:]:
        if not line or _NOISE.match(line):
            continue
        if m := _MY_SCHEDULE.match(line):
            name = " ".join(x.strip() for x in (m[1], m[2]) if x).lower()
            title, schedule = out.add("schedule", 0, "-".join(["schedule", *name.split()]), f"Schedule {name}".strip(), m[3]), True
            title = None if title.heading else title
            continue
        if not schedule:
            if m := _MY_PART.match(line):
                title = out.add("part", 1, f"part-{m[1].lower()}", f"Part {m[1]}", m[2])
                title = None if title.heading else title
                continue
            if m := _MY_CHAPTER.match(line):
                title = out.add("chapter", 2, f"{m[1].lower()}-{m[2].lower()}", f"{m[1].title()} {m[2]}", m[3])
                title = None if title.heading else title
                continue
            if (m := _MY_SECTION.match(line)) and (int(m[1]) == last + 1 and not m[2] or int(m[1]) == last and m[2]):
                last, letter, title = int(m[1]), "", None
                out.add("section", 3, f"section-{m[1]}{m[2].lower()}", f"Section {m[1]}{m[2]}")
                line = m[3]
            if line and out.has("section"):
                label = label_of(line)
                if label and label.bracket and label.mark.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ").isdigit():
                    letter, title = "", None
                    out.add("subsection", 4, f"subsection-{label.mark.lower()}", f"({label.mark})")
                    line = label.rest
                    label = label_of(line)
                if label and label.bracket and label.mark.isascii() and label.mark.isalpha() and label.mark.islower() and len(label.mark) <= 5:
                    token = label.mark
                    follows = bool(letter) and len(token) == 1 and ord(token) == ord(letter[-1]) + 1
                    title = None
                    if _ROMAN.match(token) and letter and not follows:
                        out.add("subparagraph", 6, f"sub-{token}", f"({token})")
                    else:
                        out.add("paragraph", 5, f"para-{token}", f"({token})")
                        letter = token
                    line = label.rest
        if not line:
            continue
        if title is not None:
            title.heading, title = line, None
        else:
            out.text(line)
    if not out.nodes:
        whole = "\n".join(line for line in lines if line)
        return [("text", "fulltext", "Full text", whole)] if whole else []
    return out.rows()


# --- trees and layout -----------------------------------------------------------------------------------------------------

#: Kinds of provision nodes by name and by number.
TREE_NAMES = {"phần": "part", "chương": "chapter", "mục": "section", "tiểu mục": "section", "điều": "article", "khoản": "clause", "điểm": "point", "phụ lục": "appendix"}
TREE_TYPES = {1: "part", 2: "chapter", 3: "section", 4: "section", 5: "article", 6: "clause", 7: "point"}
_LEVEL = {"part": 1, "appendix": 1, "chapter": 2, "section": 3, "article": 4, "clause": 5, "point": 6}
_SEGMENT = {"part": "phan", "appendix": "phu-luc", "chapter": "chuong", "section": "muc", "article": "dieu", "clause": "khoan", "point": "diem"}


def parse_tree(payload: str | None) -> list[tuple[str, str, str, str]]:
    """Rows of a provision tree in JSON, an array of nodes or an object with such an array as data. Nodes of an unknown kind
    hand their children to the node above. A node's own text is its content less the first occurrence of each child's
    and a leading label. Null, invalid and empty payloads give no rows."""
    try:
        data = json.loads(payload or "null")
    except ValueError:
        return []
    nodes = data.get("data") if isinstance(data, dict) else data
    if not isinstance(nodes, list):
        return []
    out = Outline(lambda path, n: f"{path}~{n}")
    todo = [(n, 0) for n in reversed(nodes)]
    while todo:  # a stack: trees may be deep
        node, floor = todo.pop()
        if not isinstance(node, dict):
            continue
        children = sorted((c for c in node.get("children") or [] if isinstance(c, dict)), key=lambda c: c.get("orderIndex") or 0)
        kind = TREE_NAMES.get(str(node.get("level") or "").strip().lower()) or TREE_TYPES.get(node.get("ptype"))
        if kind:
            content = node.get("content") or {}
            key = str(node.get("key") or node.get("title") or len(out.nodes) + 1).strip()
            number = re.sub(r"[^0-9a-zđ]+", "-", key.lower().split()[-1] if key else "").strip("-") or "x"
            level = max(_LEVEL[kind], floor + 1)
            made = out.add(kind, level, f"{_SEGMENT[kind]}-{number}", str(node.get("title") or key), str(content.get("title") or ""))
            own = html_text(content.get("content")) or ""
            for c in children:
                part = html_text((c.get("content") or {}).get("content")) or ""
                if part:
                    own = own.replace(part, "", 1)
            for label in (f"{made.label}.", f"{made.label}:", made.label):
                own = own.strip().removeprefix(label)
            if own.strip():
                made.body.append(own.strip())
            floor = level
        todo.extend((c, floor) for c in reversed(children))
    return out.rows()


def choose_vn(tree: str | None, text: str | None) -> list[tuple[str, str, str, str]]:
    """The tree where it is available and gives rows, else the text."""
    return parse_tree(tree) or parse_vn(text)


def parse_layout(payload: str | None) -> list[tuple[str, str, str, str]]:
    """Rows of a layout service's blocks: titles and headings open sections by their depth, the rest is text, table rows are
    joined by ' | '."""
    try:
        blocks = json.loads(payload or "null")["document"]["documentLayout"]["blocks"]
    except (ValueError, TypeError, KeyError):
        return []
    out, n = Outline(lambda path, k: f"{path}~{k}"), 0
    todo = list(reversed(blocks))
    while todo:
        block = todo.pop()
        if table := block.get("tableBlock"):
            for row in [*(table.get("headerRows") or []), *(table.get("bodyRows") or [])]:
                cells = [" ".join(b.get("textBlock", {}).get("text", "") for b in c.get("blocks") or []) for c in row.get("cells") or []]
                out.text(" | ".join(cells))
            continue
        body = block.get("textBlock") or {}
        kind, text = body.get("type") or "", (body.get("text") or "").strip()
        depth = 1 if kind == "title" else int(kind.rsplit("-", 1)[1]) + 1 if re.fullmatch(r"heading-\d+", kind) else 0
        if depth and text:
            n += 1
            out.add("heading", depth, f"h-{n}", text)
        elif text:
            out.text(text)
        todo.extend(reversed(body.get("blocks") or []))
    return out.rows()


GRAMMARS = {"vn": parse_vn, "my": parse_my, "tree": parse_tree, "layout": parse_layout}
SECTIONS = "doc_id {key}, position int, kind string, citation_path string, heading_path string, body string, error string"


def sections(docs: DataFrame, grammar: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section of every document, in order. A document that fails gives one row with its error and no others."""
    parse, schema = GRAMMARS[grammar], SECTIONS.format(key=docs.schema[key].dataType.simpleString())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            rows: list[tuple] = []
            for k, t in frame.itertuples(index=False, name=None):
                try:
                    rows += [(k, i, *r, None) for i, r in enumerate(parse(t if isinstance(t, str) else None))]
                except Exception as e:  # one document never ends the run
                    rows.append((k, 0, None, None, None, None, f"{type(e).__name__}: {e}"))
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return spread(docs.select(F.col(key), F.col(text))).mapInPandas(run, schema).withColumnRenamed("doc_id", key)
