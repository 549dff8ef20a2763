"""Command line.

search, lexical, index, info, convert and check print JSON; failures go to
stderr with code 1. The verifiers and the PDF commands print lines and have
codes of their own.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import api, verify
from .session import session
from .sources import pdf


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="folioforge")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("search", "lexical"):
        sub = commands.add_parser(name)
        sub.add_argument("question")
        sub.add_argument("--dir", action="append", required=True)
        sub.add_argument("--top-k", type=int, default=api.DEFAULT_TOP)
    sub = commands.add_parser("index")
    sub.add_argument("directory")
    sub.add_argument("--exclude-callout", action="append", default=[])
    sub.add_argument("--provider", default="local")
    commands.add_parser("info").add_argument("directory")
    sub = commands.add_parser("convert")
    sub.add_argument("document")
    sub.add_argument("--output")
    sub.add_argument("--provider")
    commands.add_parser("check")
    sub = commands.add_parser("verify-citations")
    sub.add_argument("vault")
    sub.add_argument("notes", nargs="*")
    sub = commands.add_parser("verify-entries")
    sub.add_argument("--source", nargs="*", action="extend", default=[])
    sub.add_argument("--note", nargs="*", action="extend", default=[])
    sub.add_argument("--anchor")
    for name in ("pdf-text", "pdf-images", "pdf-signatures"):
        sub = commands.add_parser(name)
        sub.add_argument("file")
        if name == "pdf-images":
            sub.add_argument("--out", default=".")
    return parser


def _pdf(command: str, given: argparse.Namespace) -> int:
    """One file, read in the driver's own Python: 0 found, 1 nothing found, 2 not to be trusted or unsigned, 3 unreadable."""
    path = Path(given.file)
    if not path.is_file():
        print(f"no such file: {path}", file=sys.stderr)
        return verify.WRONG
    raw = path.read_bytes()
    if command == "pdf-text":
        pages = pdf.page_texts(raw)
        chars, drawn, known = sum(len(p[0]) for p in pages), sum(p[1] for p in pages), sum(p[2] for p in pages)
        print("\n\n".join(p[0] for p in pages))
        if chars < pdf.MIN_CHARS:
            return 1
        return 2 if chars // len(pages) < pdf.MIN_PER_PAGE or known < pdf.MIN_RATE * drawn else 0
    if command == "pdf-images":
        found = pdf.images(raw)
        Path(given.out).mkdir(parents=True, exist_ok=True)
        for n, kind, w, h, file in found:
            if file:
                name = f"{path.stem}-image-{n:04d}.{kind}"
                (Path(given.out) / name).write_bytes(file)
                print(f"{name}  {w}x{h}")
        print(f"too small: {sum(x[1] == 'small' for x in found)}, not decoded: {sum(x[1] == 'failed' for x in found)}", file=sys.stderr)
        return 0 if any(x[4] for x in found) else 1
    found = pdf.signatures(raw)
    for s in found:
        if s[1]:
            print(f"{s[2] or s[3] or 'unnamed'}  {s[6] or 'no date'}  {s[7] or 'no format'}")
    signed, fields = [s for s in found if s[1]], sum(not s[1] for s in found)
    print(f"signatures: {len(signed)}, empty fields: {fields}" + ("" if not signed or signed[0][8] else ", the file was changed after it was signed"), file=sys.stderr)
    return 0 if signed else 2 if fields else 1


def main(argv: list[str] | None = None) -> int:
    given = _parser().parse_args(argv)
    if given.command.startswith("pdf-"):
        return _pdf(given.command, given)
    if given.command == "check":
        print(json.dumps(api.llm_check(), ensure_ascii=False, indent=2))
        return 0
    spark = session()
    if given.command.startswith("verify-"):
        done = verify.verify_citations(spark, given.vault, given.notes) if given.command == "verify-citations" else verify.verify_entries(spark, given.source, given.note, given.anchor)
        print("\n".join(done.lines), file=sys.stdout if done.code in (verify.WELL, verify.FAULTS) else sys.stderr)
        return done.code
    run = {
        "index": lambda: api.semantic_index_build(spark, given.directory, given.provider, given.exclude_callout),
        "info": lambda: api.semantic_info(spark, given.directory),
        "convert": lambda: api.ocr_convert(spark, given.document, given.output, given.provider),
        "search": lambda: api.semantic_search(spark, given.question, given.dir, given.top_k),
        "lexical": lambda: api.lexical_search(spark, given.question, given.dir, given.top_k),
    }[given.command]
    try:
        out = run()
    except Exception as trouble:
        print(trouble, file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
