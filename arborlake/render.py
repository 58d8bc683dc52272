"""A report as JSON or as text; works on the one collected row."""

from __future__ import annotations

import json
import math
import os
import sys
from typing import Any, TextIO

BOLD, DIM, RED, GREEN, YELLOW, CYAN, RESET = "\033[1m", "\033[2m", "\033[31m", "\033[32m", "\033[33m", "\033[36m", "\033[0m"


def colored(no_color: bool, stream: TextIO) -> bool:
    """Whether to use colours: an explicit refusal, then the environment's, then whether it is a terminal."""
    return not no_color and not os.environ.get("NO_COLOR") and stream.isatty()


def report_of(row) -> dict[str, Any]:
    """A collected row as the report's object: absent parts left out, the id as ``rootPath``."""
    fields = row.asDict(recursive=True)
    head = {"scannedAt": fields.pop("scannedAt"), "rootPath": fields.pop("repo_id")}
    return {**head, **_without_nulls(fields)}


def _without_nulls(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _without_nulls(v) for k, v in value.items() if v is not None}
    return [_without_nulls(v) for v in value] if isinstance(value, list) else value


def _paint(text: str, sign: str, color: bool) -> str:
    return f"{sign}{text}{RESET}" if color else text


def to_json(value: Any, color: bool = False, depth: int = 0) -> str:
    """JSON with two blanks of indentation; numbers that are no JSON become null."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return _paint("null", BOLD, color)
    if isinstance(value, bool):
        return _paint(str(value).lower(), BOLD, color)
    if isinstance(value, (int, float)):
        plain = str(int(value)) if float(value).is_integer() else repr(value)
        return _paint(plain, YELLOW, color)
    if isinstance(value, str):
        return _paint(json.dumps(value, ensure_ascii=False), GREEN, color)
    inner, outer = "  " * (depth + 1), "  " * depth
    if isinstance(value, dict):
        parts = [f"{inner}{_paint(json.dumps(k, ensure_ascii=False), CYAN, color)}: {to_json(v, color, depth + 1)}" for k, v in value.items()]
        return "{\n" + ",\n".join(parts) + f"\n{outer}}}" if parts else "{}"
    parts = [inner + to_json(v, color, depth + 1) for v in value]
    return "[\n" + ",\n".join(parts) + f"\n{outer}]" if parts else "[]"


def write(text: str, stream: TextIO | None = None) -> None:
    """One write; a reader that went away is no error."""
    stream = stream or sys.stdout
    try:
        stream.write(text)
        stream.flush()
    except BrokenPipeError:
        pass


def share_text(files: int, percentage: float) -> str:
    return "< 0.1" if files > 0 and percentage < 0.1 else f"{percentage:5.1f}"


def to_table(report: dict[str, Any], title: str = "arborlake") -> str:
    """Sections in fixed order; parts that weren't run have none."""
    out = [f"{BOLD}{title}{RESET} — scanned {report['rootPath']}\n"]
    head = lambda text: out.append(f"\n{BOLD}{CYAN}{text}{RESET}\n")
    none = f"{DIM}(none){RESET}"
    listed = lambda items: ", ".join(items) if items else none
    inventory, stats = report.get("inventory") or {}, report.get("languageStats")
    if stats or "languages" in inventory:
        head("Languages")
        if stats and stats["perLanguage"]:
            out.append(f"  {DIM}{stats['totalFiles']:,} files, {stats['totalLines']:,} lines{RESET}\n")
            for e in stats["perLanguage"]:
                counts = f"{DIM}({e['files']:>4} files, {format(e['lines'], ','):>8} lines){RESET}"
                out.append(f"    {YELLOW}{e['language']:<14}{RESET} {share_text(e['files'], e['percentage'])}%  {counts}\n")
        else:
            out.append(f"  {listed(inventory.get('languages', []))}\n")
    sections = (("frameworks", "Frameworks"), ("packageManagers", "Package managers"), ("buildSystems", "Build systems"), ("ciProviders", "CI providers"), ("containerization", "Containerization"))
    for key, name in sections:
        if key in inventory:
            head(name)
            out.append(f"  {listed(inventory[key])}\n")
    if "runtimes" in inventory:
        head("Runtimes")
        runtimes = inventory["runtimes"]
        width = max((len(r["language"]) for r in runtimes), default=0)
        out += [f"  {YELLOW}{r['language']:<{width}}{RESET}  {r['version']}  {DIM}(from {r['source']}){RESET}\n" for r in runtimes] or [f"  {none}\n"]
    if "architecture" in report:
        layout = report["architecture"]
        head("Monorepo")
        tool = f" {DIM}({layout['toolName']}){RESET}" if layout.get("toolName") else ""
        out.append(f"  {'yes' if layout['monorepo'] else 'no'}{tool}\n")
        head("Components")
        for c in layout["components"]:
            seconds = f" {DIM}(+{', +'.join(c['secondaryKinds'])}){RESET}" if c.get("secondaryKinds") else ""
            about = f" {DIM}— {c['description']}{RESET}" if c.get("description") else ""
            names = (c.get("scoped") or {}).get("frameworks") or []
            shown = listed(names[:3]) + (f" {DIM}+{len(names) - 3} more{RESET}" if len(names) > 3 else "")
            out.append(f"  {YELLOW}{c['kind']:<8}{RESET}{seconds} {c['name']}{about} {DIM}{c['path']}{RESET}  {shown}\n")
        if not layout["components"]:
            out.append(f"  {none}\n")
    return "".join(out) + "\n"
