"""Command line: ``python -m pipewright.cli -t 'customer %>% select(c_name)' -d duckdb``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import re
import sys
import time

from . import __version__
from .emit import to_sql
from .emit.dialects import dialect
from .errors import LexError, LimitError, ParseError, PipelineError
from .plans.lexer import pipe_mode, tokenize
from .plans.parser import parse
from .validate import validate

#: FIXED VALUES: exit codes.
SUCCESS = 0
GENERAL_ERROR = 1
INVALID_ARGUMENTS = 2
IO_ERROR = 3
VALIDATION_ERROR = 4
TRANSPILATION_ERROR = 5
CONFIG_ERROR = 6
PERMISSION_ERROR = 7
SYSTEM_ERROR = 8
NETWORK_ERROR = 9
TIMEOUT_ERROR = 10
INTERNAL_ERROR = 11
MOST_INPUT = 10 << 20


def one_line(sql: str) -> str:
    """White space outside strings as single spaces."""
    return "".join(p if p[:1] == "'" else re.sub(r"\s+", " ", p) for p in re.split(r"('(?:[^']|'')*')", sql)).strip()


def formatted(sql: str, style: str) -> str:
    """``pretty``: a line for each clause and condition; else one line."""
    if style != "pretty":
        return one_line(sql)
    parts = re.split(r"('(?:[^']|'')*')", "\n".join(map(one_line, sql.split("\n"))))
    return "".join(p if p[:1] == "'" else re.sub(r" (AND|OR) ", r"\n\1 ", p) for p in parts)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pipewright", description="Translate verb pipelines into SQL.")
    p.add_argument("-i", "--input", help="file with the pipeline; default: standard input")
    p.add_argument("-t", "--text", help="the pipeline itself")
    p.add_argument("-o", "--output", help="file for the SQL; default: standard output")
    p.add_argument("-d", "--dialect", default=os.environ.get("PIPEWRIGHT_DIALECT", "postgresql"), help="postgresql, mysql, sqlite, duckdb, spark")
    p.add_argument("-s", "--pipe-syntax", help="magrittr or native")
    style = p.add_mutually_exclusive_group()
    for flag, name in (("-p", "pretty"), ("-c", "compact"), ("-j", "json")):
        style.add_argument(flag, f"--{name}", action="store_const", const=name, dest="style")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--validate-only", action="store_true")
    p.add_argument("--debug", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    """Run the command; whatever it meets becomes an exit code."""
    try:
        return _run(parser().parse_args(argv))
    except TimeoutError as e:
        return _say(f"out of time: {e}", TIMEOUT_ERROR)
    except ConnectionError as e:
        return _say(f"the connection failed: {e}", NETWORK_ERROR)
    except (MemoryError, RecursionError) as e:
        return _say(f"out of memory: {e}", SYSTEM_ERROR)
    except KeyboardInterrupt:
        return _say("stopped", GENERAL_ERROR)
    except Exception as e:
        return _say(f"internal error: {type(e).__name__}: {e}", INTERNAL_ERROR)


def _run(args: argparse.Namespace) -> int:
    began = time.perf_counter()
    try:
        text = args.text if args.text is not None else open(args.input, encoding="utf-8").read() if args.input else sys.stdin.read(MOST_INPUT + 1)
    except PermissionError as e:
        return _say(f"can't read the input: {e}", PERMISSION_ERROR)
    except (OSError, UnicodeDecodeError) as e:
        return _say(f"can't read the input: {e}", IO_ERROR)
    text = text.strip()
    if not text or len(text) > MOST_INPUT:
        return _say("the input is empty" if not text else "the input is too large", IO_ERROR)
    try:
        mode = pipe_mode(args.pipe_syntax)
        if args.dialect.lower() not in ("spark", "sparksql"):
            dialect(args.dialect)
    except PipelineError as e:
        return _say(str(e), CONFIG_ERROR)
    try:
        if args.validate_only:
            report = validate(text, mode)
            print(json.dumps(dataclasses.asdict(report), indent=2) if args.style == "json" else ("valid" if report.valid else "invalid: " + "; ".join(report.problems)))
            return SUCCESS if report.valid else VALIDATION_ERROR
        tree = parse(text, mode)
        parsed = time.perf_counter()
        if args.debug:
            print(tree, file=sys.stderr)
        sql = to_sql(tree, args.dialect)
    except PipelineError as e:
        return _failed(e, args, text, began)
    if args.style == "json":
        out = json.dumps({"success": True, "sql": sql, "error": None, "metadata": _metadata(args, text, began, parsed, tree, sql, mode)}, indent=2)
    else:
        out = formatted(sql, args.style or "default")
    try:
        if args.output:
            with open(args.output, "w", encoding="utf-8") as file:
                file.write(out + "\n")
        else:
            print(out)
    except PermissionError as e:
        return _say(f"can't write the output: {e}", PERMISSION_ERROR)
    except OSError as e:
        return _say(f"can't write the output: {e}", IO_ERROR)
    if args.verbose:
        print(f"{len(tree.verbs)} verbs, {1e3 * (time.perf_counter() - began):.1f} ms", file=sys.stderr)
    return SUCCESS


def _say(message: str, code: int) -> int:
    print(message, file=sys.stderr)
    return code


def _metadata(args, text: str, began: float, parsed: float, tree=None, sql: str = "", mode: str = "magrittr") -> dict:
    now = time.perf_counter()
    source = ("text", "text") if args.text is not None else ("file", args.input) if args.input else ("stdin", "stdin")
    return {
        "timestamp": int(time.time()),
        "dialect": args.dialect,
        "stats": {
            "parse_time_us": round(1e6 * (parsed - began)),
            "generation_time_us": round(1e6 * (now - parsed)),
            "total_time_us": round(1e6 * (now - began)),
            "token_count": len(tokenize(text.rstrip(";"), mode)) - 1 if tree else 0,
            "ast_node_count": sum(1 for _ in tree.walk()) if tree else 0,
            "input_size_bytes": len(text.encode()),
            "output_size_bytes": len(sql.encode()),
        },
        "input_info": {"source_type": source[0], "source_id": source[1], "size_bytes": len(text.encode()), "line_count": text.count("\n") + 1},
        "version": __version__,
    }


def _failed(e: PipelineError, args, text: str, began: float) -> int:
    if args.style == "json":
        kind = "lex" if isinstance(e, LexError) else "parse" if isinstance(e, ParseError) else "generation"
        error = {"error_type": kind, "message": e.message, "position": e.at, "suggestions": [e.hint] if e.hint else []}
        print(json.dumps({"success": False, "sql": None, "error": error, "metadata": _metadata(args, text, began, time.perf_counter())}, indent=2))
    else:
        print(str(e), file=sys.stderr)
    return VALIDATION_ERROR if isinstance(e, (LexError, ParseError, LimitError)) else TRANSPILATION_ERROR


if __name__ == "__main__":
    sys.exit(main())
