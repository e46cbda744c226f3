"""Options from files, command lines and strings; what is given on the command line wins over the file."""

from __future__ import annotations

import argparse
import os
import shlex
from dataclasses import dataclass, fields
from pathlib import Path

from kakari.functions.patterns import POSSETS
from kakari.sources.raw import charset_of


@dataclass
class Options:
    """How to parse. A value that doesn't convert to its field's type leaves the default."""

    input_layer: int = 0
    output_layer: int = 4
    output_format: int = 0
    ne: int = 0
    posset: str = "IPA"
    charset: str = "UTF-8"
    charset_file: str = ""
    parser_model: str = ""
    chunker_model: str = ""
    ne_model: str = ""
    output: str = ""
    rcfile: str = ""

    @classmethod
    def of(cls, values: dict[str, str]) -> Options:
        """From names with - or _; unknown names are passed over, an unknown tag set becomes IPA."""
        out = cls()
        for f in fields(cls):
            raw = values.get(f.name, values.get(f.name.replace("_", "-")))
            if raw is not None:
                try:
                    setattr(out, f.name, type(f.default)(raw))
                except ValueError:
                    pass
        out.posset = out.posset.upper() if out.posset.upper() in POSSETS else "IPA"
        if out.charset_file:
            out.charset = charset_of(Path(out.charset_file).read_text().split("\n")[0])
        return out


def parse_config(text: str) -> dict[str, str]:
    """key = value lines; those that begin with ; or # and lines without = don't count, the first of a repeated key does."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        if line.strip() and line.lstrip()[0] not in ";#" and "=" in line:
            key, value = line.split("=", 1)
            out.setdefault(key.strip(), value.strip())
    return out


def find_rcfile(given: str = "") -> str | None:
    """The file given, else that of KAKARIRC, else ~/.kakarirc; the first that exists."""
    return next((p for p in (given, os.environ.get("KAKARIRC", ""), str(Path.home() / ".kakarirc")) if p and Path(p).is_file()), None)


def arguments(prog: str = "kakari") -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=prog, argument_default=argparse.SUPPRESS)
    for short, name, text in (
        ("-f", "output-format", "0 tree, 1 lattice, 2 both, 3 XML, 4 CoNLL, 5 nothing"), ("-I", "input-layer", "0 raw, 1 tokens, 2 chunks, 3 features, 4 links"), ("-O", "output-layer", "1 to 4, as for the input"),
        ("-n", "ne", "0 no entities, 1 entities within chunks, 2 entities"), ("-m", "parser-model", "link model"), ("-M", "chunker-model", "chunk model"), ("-N", "ne-model", "entity model"),
        ("-P", "posset", "IPA, JUMAN or UNIDIC"), ("-t", "charset", "of the input"), ("-T", "charset-file", "a file that names the charset"), ("-r", "rcfile", "options file"), ("-o", "output", "folder to write to"),
    ):
        p.add_argument(short, f"--{name}", help=text)
    p.add_argument("inputs", nargs="*")
    return p


def options_from(argv: list[str] | str) -> tuple[Options, list[str]]:
    """Options and inputs from arguments, or from one string of them; the options file fills what they leave open."""
    given = vars(arguments().parse_args(shlex.split(argv) if isinstance(argv, str) else argv))
    inputs = given.pop("inputs", [])
    rc = find_rcfile(given.get("rcfile", ""))
    from_file = {k.replace("-", "_"): v for k, v in (parse_config(Path(rc).read_text()) if rc else {}).items()}
    return Options.of(from_file | given), inputs
