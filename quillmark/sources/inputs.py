"""A user's own inputs: short Markdown and text files, read on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path


class InputError(ValueError):
    """An input file is missing or malformed."""


@dataclass
class Inputs:
    companies: list[dict] = field(default_factory=list)
    industries: list[str] = field(default_factory=list)
    likes: list[str] = field(default_factory=list)
    dislikes: list[str] = field(default_factory=list)
    program: dict = field(default_factory=dict)
    courses: list[dict] = field(default_factory=list)
    connections: str = ""
    resume: str | None = None


def sections(content: str) -> dict[str, list[str]]:
    """Lines under each ``## `` heading, by the heading in lower case."""
    found: dict[str, list[str]] = {}
    now = None
    for line in content.splitlines():
        if line.startswith("## "):
            now = line[3:].strip().lower()
            found.setdefault(now, [])
        elif now is not None:
            found[now].append(line)
    return found


def list_items(lines: list[str]) -> list[str]:
    """Items after ``-`` or ``1.``, without bold marks."""
    items = []
    for line in map(str.strip, lines):
        number, dot, rest = line.partition(".")
        if line.startswith("-"):
            item = line[1:]
        elif dot and number.isdigit():
            item = rest
        else:
            continue
        if item := item.replace("**", "").strip():
            items.append(item)
    return items


def yes_no(value: str) -> bool:
    answer = value.strip().lower()
    if answer in ("", "no", "n", "false"):
        return False
    if answer in ("yes", "y", "true"):
        return True
    raise InputError(f"expected yes or no, got {value!r}")


def companies_table(content: str) -> tuple[list[dict], list[str]]:
    """Companies of a table with three or four columns, and industries of a list."""
    companies, industries = [], []
    for line in map(str.strip, content.splitlines()):
        if line.startswith("|") and line.endswith("|") and len(line) > 1:
            cells = [c.strip() for c in line[1:-1].split("|")]
            if cells[0].lower() == "name" or all(set(c) <= set("-: ") for c in cells):
                continue
            if len(cells) not in (3, 4):
                raise InputError("a company row has name, website, connection and perhaps a contact")
            companies.append({
                "name": cells[0], "website": cells[1], "has_connection": yes_no(cells[2]), "connection_name": cells[3] if len(cells) == 4 else "",
            })
        elif line.startswith("-") and (item := line.lstrip("-").strip()):
            industries.append(item)
    if not companies:
        raise InputError("no companies found")
    return companies, industries


def preferences(content: str) -> tuple[list[str], list[str]]:
    parts = sections(content)
    likes, dislikes = list_items(parts.get("things i like", [])), list_items(parts.get("things i don't like", []))
    if not likes:
        raise InputError("no likes found")
    return likes, dislikes


def courses(content: str) -> tuple[dict, list[dict]]:
    parts = sections(content)
    program = {}
    for item in list_items(parts.get("program", [])):
        name, _, value = item.partition(":")
        program[name.strip()] = value.strip() or None
    found = [
        {"code": code.strip(), "title": title.strip(), "category": name.title()}
        for name, lines in parts.items() if name != "program"
        for code, colon, title in (item.partition(":") for item in list_items(lines)) if colon
    ]
    if not found:
        raise InputError("no courses found")
    return program, found


def resume_text(folder: str, names: tuple[str, ...] = ("resume_summary.md", "resume.md", "resume.txt"), most: int = 4000) -> str | None:
    """The first file that isn't empty, cut at a line end to ``most`` characters."""
    for name in names:
        path = Path(folder) / name
        if path.exists() and (content := path.read_text(encoding="utf-8").strip()):
            return content if len(content) <= most else content[:most].rsplit("\n", 1)[0].rstrip()
    return None


def load(folder: str) -> Inputs:
    """All inputs; companies, preferences and courses must be there."""

    def need(name: str) -> str:
        path = Path(folder) / name
        if not path.exists():
            raise InputError(f"missing {name}")
        return path.read_text(encoding="utf-8")

    out = Inputs()
    out.companies, out.industries = companies_table(need("list_of_companies.md"))
    out.likes, out.dislikes = preferences(need("preferences.md"))
    out.program, out.courses = courses(need("course_list.md"))
    notes = Path(folder) / "connections.md"
    out.connections = notes.read_text(encoding="utf-8") if notes.exists() else ""
    out.resume = resume_text(folder)
    return out


def env_file(path: str) -> dict[str, str]:
    """KEY=value lines; blank lines and comments are skipped, quotes removed."""
    file = Path(path)
    if not file.exists():
        return {}
    pairs = (line.strip().partition("=") for line in file.read_text(encoding="utf-8").splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}


def setting(name: str, default: str | None = None, files: dict[str, str] | None = None) -> str | None:
    return os.environ.get(name) or (files or {}).get(name) or default


def resume_aware(override: bool | None = None, files: dict[str, str] | None = None) -> bool:
    """An explicit choice, else the setting, else no."""
    return override if override is not None else (setting("RESUME_AWARE_SCORING", "", files) or "").lower() in ("1", "true", "yes", "on")


def companies_markdown(companies: list[dict], industries: list[str]) -> str:
    """The companies file's content, read back before it is returned."""
    for cell in (v for c in companies for v in (c["name"], c["website"], c.get("connection_name", ""))):
        if "|" in cell or "\n" in cell:
            raise InputError(f"a table cell can't hold {cell!r}")
    rows = ["| Name | Website | I know someone | Contact |", "| --- | --- | --- | --- |"]
    rows += [f"| {c['name']} | {c['website']} | {'yes' if c['has_connection'] else 'no'} | {c.get('connection_name', '')} |" for c in companies]
    content = "\n".join([*rows, "", *(f"- {i}" for i in industries), ""])
    companies_table(content)
    return content


def preferences_markdown(likes: list[str], dislikes: list[str]) -> str:
    lines = ["## Things I like", "", *(f"{n}. {x}" for n, x in enumerate(likes, 1)), "", "## Things I don't like", "", *(f"{n}. {x}" for n, x in enumerate(dislikes, 1)), ""]
    preferences("\n".join(lines))
    return "\n".join(lines)


EDITABLE = ("course_list.md", "connections.md", "resume_summary.md")


def editable_text(folder: str, name: str) -> str:
    """An optional text file's content, empty if it isn't there; only known names are read."""
    if name not in EDITABLE:
        raise InputError(f"{name} can't be edited")
    path = Path(folder) / name
    return path.read_text(encoding="utf-8") if path.exists() else ""


def write_editable_text(folder: str, name: str, content: str) -> None:
    """Replaces a known text file; courses must parse before and after."""
    if name not in EDITABLE:
        raise InputError(f"{name} can't be edited")
    if name == "course_list.md":
        courses(content)
    path, new = Path(folder) / name, Path(folder) / f"{name}.new"
    new.write_text(content, encoding="utf-8")
    new.replace(path)


def preferences_of(payload: dict) -> tuple[list[str], list[str]]:
    """Likes and dislikes of a request: lists of texts, at least one like."""
    likes, dislikes = payload.get("likes"), payload.get("dislikes", [])
    for items in (likes, dislikes):
        if not isinstance(items, list) or not all(isinstance(x, str) for x in items):
            raise InputError("likes and dislikes are lists of texts")
    clean = [[x.strip() for x in items if x.strip()] for items in (likes, dislikes)]
    if not clean[0]:
        raise InputError("at least one like is needed")
    return clean[0], clean[1]
