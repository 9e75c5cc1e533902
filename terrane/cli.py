"""Command line: geocode addresses, load registry files, see what is new.

    spark-submit -m terrane.cli geocode LINES [OUT] --gazetteer DIR [--target all] [--format json] [--fuzzy ?] [--debug]
    spark-submit -m terrane.cli load CSV_DIR DIR [--lgcode 131016,26....]
    spark-submit -m terrane.cli download DIR URL...
    spark-submit -m terrane.cli update-check DIR URL...
    spark-submit -m terrane.cli serve --gazetteer DIR [--port 3000]

LINES may be `-`, the standard input; without OUT, lines go to the standard output.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import functions as F

from terrane.functions.constants import FUZZY
from terrane.operators.storage import shared_folder
from terrane.plans.geocode import TARGETS, Geocoder, geocode
from terrane.server import server
from terrane.session import session
from terrane.sources import download, gazetteer, sinks
from terrane.sources.lines import comment_filtered, given_lines, read_lines, without_block_comments


def parsed(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="terrane")
    sub = parser.add_subparsers(dest="command", required=True)
    g = sub.add_parser("geocode")
    g.add_argument("lines")
    g.add_argument("out", nargs="?")
    g.add_argument("--gazetteer", required=True)
    g.add_argument("--target", choices=TARGETS, default="all")
    g.add_argument("--format", choices=list(sinks.FORMATS), default="json")
    g.add_argument("--fuzzy", nargs="?", const=FUZZY)
    g.add_argument("--debug", action="store_true")
    d = sub.add_parser("load")
    d.add_argument("csv")
    d.add_argument("out")
    d.add_argument("--lgcode", default="")
    for name in ("download", "update-check"):
        u = sub.add_parser(name)
        u.add_argument("folder")
        u.add_argument("urls", nargs="+")
    s = sub.add_parser("serve")
    s.add_argument("--gazetteer", required=True)
    s.add_argument("--port", type=int, default=3000)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = parsed(argv)
    spark = session()
    if a.command == "geocode":
        if a.lines == "-":
            lines = given_lines(spark, sys.stdin, f"{shared_folder(spark)}/terrane/lines-{uuid.uuid4().hex}")
        else:
            lines = read_lines(spark, a.lines)
        lines = without_block_comments(lines).select("line_id", comment_filtered(F.col("value")).alias("address"), F.lit(a.target).alias("target"))
        lines = lines.filter("address is not null")
        out = geocode(lines, gazetteer.read(spark, a.gazetteer), fuzzy=a.fuzzy)
        if a.out:
            sinks.write(out, a.format, a.out, a.debug)
        else:
            sinks.printed(out, a.format, a.debug)
    elif a.command == "serve":
        server(spark, Geocoder(gazetteer.read(spark, a.gazetteer)).geocode, a.port).serve_forever()
    elif a.command == "load":
        for table, changed in gazetteer.load(spark, a.csv, a.out, [c for c in a.lgcode.split(",") if c]).items():
            print(table, *(f"{k} {n}" for k, n in sorted(changed.items())))
    else:
        urls = spark.createDataFrame([(u,) for u in a.urls], "url string")
        if a.command == "download":
            rows = download.download(urls, a.folder)
        else:
            rows = download.to_update(urls, download.cache(spark, f"{a.folder}/cache"))
        for r in rows.sort("url").toLocalIterator():
            print(r["status"], r["url"])


if __name__ == "__main__":
    main()
