"""Command line: ``python -m arborlake.cli [detectors | completion SHELL] [options]``."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys

from arborlake import __version__
from arborlake.plans.rules import DETECTORS
from arborlake.render import BOLD, DIM, RESET, colored, report_of, to_json, to_table, write

PROGRAM = "arborlake"
FLAGS = ("--path", "--json", "--no-color", "--detectors", "--version", "--help")


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.exit(1, f"Error: {message}. Use --help for usage.\n")


def parser() -> Parser:
    out = Parser(prog=PROGRAM, description="Scan a repository's structure.", allow_abbrev=False)
    out.add_argument("command", nargs="*", help="detectors: list detector ids; completion [install|uninstall] bash|zsh|fish")
    out.add_argument("-p", "--path", default=".", help="directory to scan (default: the current one)")
    out.add_argument("--detectors", help="comma-separated detector ids: " + ",".join(i for i, _ in DETECTORS))
    out.add_argument("--json", action="store_true", help="print JSON instead of the table")
    out.add_argument("--no-color", action="store_true", help="no colours in JSON; NO_COLOR is honoured as well")
    out.add_argument("-v", "--version", action="version", version=__version__)
    return out


def chosen(text: str | None, fail) -> tuple[str, ...] | None:
    """The ids of a comma-separated list; doubles are reported, unknown ones refused."""
    if text is None:
        return None
    ids = [x.strip() for x in text.split(",") if x.strip()]
    known = {i for i, _ in DETECTORS}
    if not ids:
        fail("--detectors requires a comma-separated value")
    if wrong := [i for i in ids if i not in known]:
        fail(f'invalid detector ids "{",".join(wrong)}"; use some of {",".join(i for i, _ in DETECTORS)}')
    for i in dict.fromkeys(i for i in ids if ids.count(i) > 1):
        print(f'Warning: detector "{i}" selected multiple times', file=sys.stderr)
    return tuple(dict.fromkeys(ids))


def completion(shell: str) -> str:
    """A completion script for one of the three shells."""
    words, ids = " ".join(("detectors", "completion", *FLAGS)), " ".join(i for i, _ in DETECTORS)
    if shell == "bash":
        return f'_{PROGRAM}() {{\n  local last="${{COMP_WORDS[COMP_CWORD-1]}}" now="${{COMP_WORDS[COMP_CWORD]}}"\n  if [ "$last" = --detectors ]; then COMPREPLY=($(compgen -W "{ids}" -- "$now"))\n  else COMPREPLY=($(compgen -W "{words}" -- "$now")); fi\n}}\ncomplete -F _{PROGRAM} {PROGRAM}\n'
    if shell == "zsh":
        return f"#compdef {PROGRAM}\n_arguments '*--detectors[detector ids]:ids:({ids})' '*:word:({words})'\n"
    return "".join(f"complete -c {PROGRAM} -f -a '{w}'\n" for w in ("detectors", "completion")) + f"complete -c {PROGRAM} -f -l detectors -a '{ids}'\n" + "".join(f"complete -c {PROGRAM} -l {f[2:]}\n" for f in FLAGS if f != "--detectors")


def _shared_folders(shell: str) -> list[str]:
    """Folders outside the home that the shell looks into for completions, the best first."""
    prefixes = list(dict.fromkeys(p for p in (os.environ.get("HOMEBREW_PREFIX"), "/opt/homebrew", "/usr/local") if p))
    if shell == "bash":
        return [f"{p}/etc/bash_completion.d" for p in prefixes]
    if shell == "zsh":
        return [*_zsh_path(), *(f"{p}/share/zsh/site-functions" for p in prefixes)]
    return []


def _zsh_path() -> list[str]:
    """The folders that zsh itself names; none without zsh."""
    try:
        asked = subprocess.run(["zsh", "-ic", "print -l -- $fpath"], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, stdin=subprocess.DEVNULL, text=True, timeout=20)
    except (OSError, subprocess.SubprocessError):
        return []
    return [line.strip() for line in asked.stdout.splitlines() if line.strip()] if asked.returncode == 0 else []


def completion_file(shell: str) -> str:
    """Where a completion script belongs: the first shared folder that can be written to, else one in the home."""
    name = {"bash": PROGRAM, "zsh": f"_{PROGRAM}", "fish": f"{PROGRAM}.fish"}[shell]
    for folder in _shared_folders(shell):
        if os.path.isdir(folder) and os.access(folder, os.W_OK):
            return os.path.join(folder, name)
    home = os.environ.get("HOME") or os.getcwd()
    data = os.environ.get("XDG_DATA_HOME") or os.path.join(home, ".local/share")
    return os.path.join({"bash": f"{data}/bash-completion/completions", "zsh": f"{home}/.zfunc", "fish": f"{home}/.config/fish/completions"}[shell], name)


def main(argv: list[str] | None = None) -> int:
    parse = parser()
    args = parse.parse_args(argv)
    command = args.command
    if command[:1] == ["detectors"] and len(command) == 1:
        rows = [{"id": i, "description": d} for i, d in DETECTORS]
        write(json.dumps(rows, indent=2) + "\n" if args.json else "".join(f"{BOLD}{r['id']}{RESET}  {DIM}{r['description']}{RESET}\n" for r in rows))
        return 0
    if command[:1] == ["completion"]:
        action = command[1] if len(command) == 3 and command[1] in ("install", "uninstall") else None
        shell = command[-1] if len(command) in (2, 3) else ""
        if shell not in ("bash", "zsh", "fish") or (len(command) == 3 and not action):
            parse.error("completion requires a shell: bash, zsh or fish")
        path = completion_file(shell)
        if action == "install":
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as file:
                file.write(completion(shell))
        elif action == "uninstall":
            if os.path.exists(path):
                os.remove(path)
        else:
            write(completion(shell))
        return 0
    if command:
        parse.error(f'unexpected argument "{command[0]}"')
    ids = chosen(args.detectors, parse.error)
    if not os.path.isdir(args.path):
        print(f"Error: no such directory: {args.path}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from arborlake.api import scan

    spark = SparkSession.builder.appName(PROGRAM).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    rows = scan(spark, args.path, detectors=ids).collect()
    # a directory without any file has no row
    report = report_of(rows[0]) if rows else {"rootPath": os.path.abspath(args.path)}
    write(to_json(report, colored(args.no_color, sys.stdout)) + "\n" if args.json else to_table(report))
    return 0


if __name__ == "__main__":
    sys.exit(main())
