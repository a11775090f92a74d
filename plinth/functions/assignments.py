"""Lines of personnel lists: ``to(from) name`` with ditto marks, and how an assignment divides into unit and title.

The words are parameters (``Words``). A line is read in steps that each may give nothing: the name at the end, the two
assignments before it, the ditto marks resolved from what was carried along, the division of each assignment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from plinth.functions.text import HONORIFICS, normalize


@dataclass(frozen=True)
class Words:
    """Fixed values of the domain."""

    top_suffixes: tuple[str, ...] = ("部", "局", "学園", "学院", "センター", "事務所", "市", "町", "県")
    unit_suffixes: tuple[str, ...] = ("部", "局", "学園", "学院", "センター", "事務所", "市", "町", "県", "課", "室", "所", "班", "係", "チーム", "グループ", "担当")
    titles: tuple[str, ...] = ("政策統括監", "統括監", "副部長", "部長", "副局長", "局長", "副課長", "課長", "室長", "副所長", "所長", "係長", "班長", "主任主査", "主査", "主任", "主幹", "主事", "技師", "技監", "参事", "理事")
    implied: tuple[tuple[str, str], ...] = (("部長", "部"), ("局長", "局"), ("課長", "課"), ("室長", "室"), ("所長", "所"), ("係長", "係"), ("班長", "班"))
    ditto: str = "同"
    retirement: str = "退職"
    not_rows: tuple[str, ...] = ("人事異動",)

    @cached_property
    def by_length(self) -> tuple[str, ...]:
        return tuple(sorted(self.titles, key=len, reverse=True))

    @cached_property
    def unit_end(self) -> re.Pattern:
        return re.compile(_any(self.unit_suffixes) + "$")

    @cached_property
    def last_unit(self) -> re.Pattern:
        return re.compile(f"^(.*{_any(self.unit_suffixes)})(.+)$")

    @cached_property
    def top(self) -> re.Pattern:
        return re.compile(f"^(.*?)({_any(self.top_suffixes)})")


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + ")"


DEFAULT = Words()
#: A family and a given name at the end of a line, each of one to five name characters.
_NAME = re.compile(r"(?:^|(?<=[\s)）]))([㐀-鿿々ぁ-んァ-ヶー]{1,5}) ([㐀-鿿々ぁ-んァ-ヶー]{1,5}?)(?:" + "|".join(HONORIFICS) + r")?$")
_PARTS = re.compile(r"^(.*?)\s*[(（]([^()（）]+)[)）]$")


def assignment_parts(text: str) -> tuple[str, str]:
    """(assignment, former assignment in brackets at the end); empty without brackets."""
    whole = normalize(text) or ""
    m = _PARTS.match(whole)
    return (m[1].strip(), m[2].strip()) if m else (whole, "")


def implied_unit(title: str, words: Words = DEFAULT) -> str:
    """The suffix of the unit that a title heads: of the first pair whose title ends it."""
    return next((unit for end, unit in words.implied if title.endswith(end)), "")


def is_unit_name(text: str, words: Words = DEFAULT) -> bool:
    return words.unit_end.search(text) is not None


def last_unit_end(text: str, words: Words = DEFAULT) -> int:
    """Where the last unit suffix that is not at the very end ends; -1 without one."""
    m = words.last_unit.match(text)
    return len(m[1]) if m else -1


def unit_and_title(text: str, words: Words = DEFAULT) -> tuple[str, str]:
    """The first reading of an assignment whose unit is one; all as title where there is none."""
    whole = (normalize(text) or "").strip(" =＝")
    for unit, title in _readings(whole, words):
        unit = unit.strip(" 　・,、")
        if unit and is_unit_name(unit, words):
            return unit, title.strip(" =＝")
    return "", whole


def _readings(whole: str, words: Words) -> Iterator[tuple[str, str]]:
    first, _, rest = whole.replace("＝", "=").partition("=")
    first = first.strip()
    for title in words.by_length:
        at = first.find(title)
        if at > 0:
            before = first[:at]
            yield (before if is_unit_name(before, words) else before + implied_unit(title, words)), first[at:]
    yield first, rest
    end = last_unit_end(first, words)
    if end > 0:
        yield first[:end], first[end:]


@dataclass
class Carried:
    """What a ditto mark may stand for: the assignment before, and the top unit it begins with."""

    before: str = ""
    prefix: str = ""

    def resolve(self, text: str, words: Words) -> str:
        if not text.startswith(words.ditto):
            return text
        rest = text[len(words.ditto) :]
        if not rest:
            return self.before or self.prefix
        return self.prefix + rest if self.prefix else rest.lstrip("=＝")

    def after(self, assignment: str, words: Words) -> Carried:
        if not assignment:
            return self
        m = words.top.match(assignment)
        return Carried(assignment, m[0] if m else assignment)


def parse_line(line: str, section: str, article: str, carried: Carried, words: Words = DEFAULT) -> tuple[dict[str, str] | None, Carried]:
    """(row or None, what is carried on). In an article about retirements an assignment without a former one was left."""
    whole = normalize(line) or ""
    name = _NAME.search(whole)
    if not name or any(w in whole for w in words.not_rows):
        return None, carried
    to, origin = (carried.resolve(x, words) for x in assignment_parts(whole[: name.start()]))
    left = words.retirement in article and not assignment_parts(whole[: name.start()])[1]
    origin, to = (to, "") if left else (origin, to)
    (to_unit, to_title), (from_unit, from_title) = unit_and_title(to, words), unit_and_title(origin, words)
    row = {"section": section, "name": f"{name[1]} {name[2]}", "to_unit": to_unit, "to_title": to_title, "from_unit": from_unit, "from_title": from_title, "evidence": whole}
    return row, carried.after(to, words)


def parse_article(lines: list[tuple[str, str]], article: str, words: Words = DEFAULT) -> list[dict[str, str]]:
    """Rows of an article's (kind, text) lines; a heading starts a section and forgets what was carried."""
    out, section, carried = [], "", Carried()
    for kind, text in lines:
        if kind == "heading":
            section, carried = (normalize(text) or ""), Carried()
            continue
        row, carried = parse_line(text, section, article, carried, words)
        if row:
            out.append(row)
    return out
