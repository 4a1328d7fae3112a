"""``python -m quillspan``: HTML from standard input, converted to standard output as it comes.

Input is read in blocks, decoded across their borders, and put out as far as it can't change any more.
"""

from __future__ import annotations

import argparse
import codecs
import sys
from typing import BinaryIO, TextIO

from quillspan.operators.incremental import Converter
from quillspan.operators.options import minimal, options

BLOCK = 8192


def main(argv: list[str] | None = None, source: BinaryIO | None = None, sink: TextIO | None = None) -> None:
    a = argparse.ArgumentParser(prog="quillspan", description="HTML to Markdown, text or safe HTML")
    a.add_argument("--origin", default="")
    a.add_argument("--format", choices=("markdown", "text", "html"), default="markdown")
    a.add_argument("--text", action="store_true")
    a.add_argument("--preset", choices=("minimal",))
    a.add_argument("--clean-urls", action="store_true")
    a.add_argument("--wrap-width", type=int, default=0)
    a.add_argument("--verbose", action="store_true")
    given = a.parse_args(argv)
    source, sink = source or sys.stdin.buffer, sink or sys.stdout
    o: dict = {"origin": given.origin, "wrap_width": given.wrap_width}
    if given.clean_urls:
        o["clean"] = frozenset({"urls"})
    made = minimal(**{k: v for k, v in o.items() if v}) if given.preset else options(**o)
    output = "text" if given.text else {"markdown": "markdown", "text": "text", "html": "safe_html"}[given.format]
    converter = Converter(output, made)
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    read = written = 0
    while block := source.read(BLOCK):
        read += len(block)
        written += sink.write(converter.process(decode(block)))
    written += sink.write(converter.process(decode(b"", True)) + converter.finish())
    if given.verbose:
        print(f"{read} bytes in, {written} characters out", file=sys.stderr)


if __name__ == "__main__":
    main()
