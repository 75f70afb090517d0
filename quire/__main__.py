"""The command line: ``python -m quire INPUT OUTPUT``.

INPUT is a file, a folder or a pattern. With one input file OUTPUT is a file; otherwise it is a
folder that receives one file for each book, written by the executors.
"""

from __future__ import annotations

import argparse
import os
import posixpath
import sys
from dataclasses import replace

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions.text import FORMATS
from .options import Options
from .plans import convert as C
from .plans import pdf as P
from .sources import books as R
from .sources import pdf as S
from .store import cut


def _arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quire", description="Convert collections of books.")
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?")
    p.add_argument("--from", dest="source", choices=sorted({*FORMATS.values(), "pdfxml"}))
    p.add_argument("--to", dest="target", choices=sorted(C.WRITERS))
    p.add_argument("--config", action="append", default=[], help="TOML file; later ones go over earlier ones")
    p.add_argument("-v", "--verbose", action="count")
    p.add_argument("--extra-css")
    p.add_argument("--max-image-size", help="WIDTHxHEIGHT")
    p.add_argument("--jpeg-quality", type=int)
    p.add_argument("--debug-pipeline")
    p.add_argument("--pdf-engine")
    p.add_argument("--pdf-dpi", type=int)
    p.add_argument("--chapter-regex")
    for flag in ("unsmarten-punctuation", "remove-first-image", "insert-metadata", "linearize-tables", "no-images"):
        p.add_argument(f"--{flag}", action="store_true", default=None)
    p.add_argument("--dump-config", action="store_true")
    return p.parse_args(argv)


def options(args: argparse.Namespace) -> Options:
    """Configuration files, then the command line. A malformed size is ignored."""
    out = Options()
    for path in args.config:
        with open(path, encoding="utf-8") as f:
            out = Options.load(f.read(), out)
    given = {k: v for k, v in vars(args).items() if v is not None and k in Options.__dataclass_fields__}
    raw = {k: given.pop(k) for k in ("max_image_size", "jpeg_quality", "pdf_engine") if k in given}
    size = Options.load(f'max_image_size = "{raw["max_image_size"]}"').max_image_size if "max_image_size" in raw else None
    if size:
        given["max_image_size"] = size
    if "jpeg_quality" in raw:
        given["jpeg_quality"] = min(100, max(1, raw["jpeg_quality"]))
    if "pdf_engine" in raw:
        given["pdf_engine"] = raw["pdf_engine"] if raw["pdf_engine"] in ("auto", "text-only", "image-only") else "auto"
    return replace(out, **given)


def _beside(href: str) -> str | None:
    """A picture's name below the book's folder; None for one that leads out of it."""
    name = posixpath.normpath(href)
    return None if name.startswith(("/", "..")) else name


def _write_partition(folder: str, ext: str):
    def run(rows) -> None:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)

        def put(name: str, data: bytes) -> None:
            where.create_dir(posixpath.dirname(name), recursive=True)
            with where.open_output_stream(name + ".part") as f:
                f.write(bytes(data))
            where.move(name + ".part", name)  # a task that runs twice leaves one whole file

        for r in rows:
            if r["data"] is None:
                continue
            name = f"{base}/{r['stem']}-{r['book_id'] & 0xFFFFFFFF:08x}"
            if r["files"]:  # a page with pictures has a folder of its own
                put(f"{name}/{r['stem']}.{ext}", r["data"])
                for f in r["files"]:
                    if _beside(f["href"]):
                        put(f"{name}/{_beside(f['href'])}", f["data"])
            else:
                put(f"{name}.{ext}", r["data"])

    return run


def _books(spark: SparkSession, path: str, source: str | None, o: Options) -> R.Books:
    """The books of the files at ``path``. Files of no known format are not books, unless the format is
    given or there is one file; pages of HTML take the sheets and pictures beside them, and page
    XML (``--from pdfxml``) its pictures and the pages rendered as NAME-NUMBER.jpg."""
    files = R.list_files(spark, path)
    folder = os.path.dirname(os.path.abspath(path)) if os.path.isfile(path) else None
    near = R.list_files(spark, folder) if folder else files
    if source == "pdfxml":
        folder_of = F.regexp_replace("path", "[^/]*$", "")
        xml = files.where(F.endswith(F.lower("path"), F.lit(".xml")))
        pdf = near.where(F.endswith(F.lower("path"), F.lit(".pdf"))).select(F.regexp_replace("path", r"\.[^./]*$", "").alias("base"), F.col("data").alias("pdf"))
        shown = near.where(X.mime_type(F.col("path")).startswith("image/")).select(folder_of.alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("data").alias("bytes"))
        at = xml.select("book_id", folder_of.alias("folder"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.pdf)?\.[^.]*$", "").alias("stem"), F.regexp_replace("path", r"(\.pdf)?\.[^./]*$", "").alias("base"))
        pictures = at.join(shown, "folder").select("book_id", F.col("name").alias("src"), F.col("bytes").alias("data"))
        number = F.regexp_extract("name", r"-0*(\d{1,8})\.jpe?g$", 1)
        rendered = at.join(shown, "folder").where(F.startswith("name", F.concat("stem", F.lit("-"))) & (number != "")).select("book_id", number.cast("int").alias("number"), F.col("bytes").alias("data"))
        info = S.pdf_info(at.join(pdf, "base").select("book_id", "pdf"), "pdf")
        return P.pdf_books(xml, pictures, rendered, info, o.pdf_engine)
    known = files if source or folder else files.where(X.book_format(F.col("path")).isNotNull())
    raw = cut(R.read_books(known, source), "raw")  # five tables are read from it
    return R.with_assets(R.tables(raw), near)


def main(argv: list[str]) -> int:
    args = _arguments(argv)
    o = options(args)
    if args.dump_config:
        print(o.dump(), end="")
        return 0
    if not args.input or not args.output:
        print("an input and an output are needed", file=sys.stderr)
        return 2
    target = args.target or FORMATS.get(args.output.rsplit(".", 1)[-1].lower())
    if target not in C.WRITERS:
        print(f"no writer for {target or args.output}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quire").getOrCreate()
    books, stages = _books(spark, args.input, args.source, o), C.standard_stages(o)
    if o.verbose:
        print(f"read as books, through {', '.join(n for n, _ in stages)}, to {target}", file=sys.stderr)
    if o.debug_pipeline:
        C.dump(books, f"{o.debug_pipeline}/input")
        books, stages = C.apply(books, stages), []
        C.dump(books, f"{o.debug_pipeline}/transforms")
    done = C.convert(books, target, o, stages)
    if os.path.isfile(args.input):
        row = done.first()
        if row is None or row["data"] is None:
            print(row["error"] if row else "nothing read", file=sys.stderr)
            return 1
        with open(args.output, "wb") as f:
            f.write(bytes(row["data"]))
        for f in row["files"] or ():
            name = _beside(f["href"])
            if name:
                place = os.path.join(os.path.dirname(os.path.abspath(args.output)), name)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "wb") as out:
                    out.write(bytes(f["data"]))
        return 0
    folder = args.output if "://" in args.output else "file://" + os.path.abspath(args.output)
    done = cut(done, "converted")
    done.foreachPartition(_write_partition(folder, target))
    failed = done.where("data is null")
    n = failed.count()
    for r in failed.select("stem", "error").orderBy("stem").limit(20).collect():
        print(f"{r['stem']}: {r['error']}", file=sys.stderr)
    if n:
        print(f"{n} of {done.count()} books were not converted", file=sys.stderr)
    return 1 if n else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
