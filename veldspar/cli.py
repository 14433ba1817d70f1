"""Command line: list, dump, export, import and serve collections.

    python -m veldspar.cli --data-folder DIR --list
    python -m veldspar.cli --data-folder DIR --export NAME --output FILE
    python -m veldspar.cli --data-folder DIR --import FILE --name NAME
    python -m veldspar.cli --data-folder DIR --import-spans FILE --name NAME
    python -m veldspar.cli --data-folder DIR --dump NAME
    python -m veldspar.cli --data-folder DIR --serve --host HOST:PORT
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from . import service
from .engine import Engine, EngineConfig
from .sources import exchange, spans


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="veldspar", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--data-folder", default=EngineConfig.from_env().data_folder)
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--list", action="store_true", help="the collections and their statistics")
    what.add_argument("--dump", metavar="NAME", help="the files that hold a collection")
    what.add_argument("--export", metavar="NAME", help="a collection as JSON")
    what.add_argument("--import", metavar="FILE", dest="source", help="a collection from JSON")
    what.add_argument("--import-spans", metavar="FILE", dest="spans", help="a collection from a span file")
    what.add_argument("--serve", action="store_true", help="answer requests over HTTP")
    p.add_argument("--host", default="127.0.0.1:8080", help="where to serve")
    p.add_argument("--folder", action="store_true", help="export to, or import from, a folder of JSON lines, in parallel")
    p.add_argument("--output", help="file to write to (default: standard output)")
    p.add_argument("--name", help="name of the imported collection")
    a = p.parse_args(args)
    if (a.source or a.spans) and not a.name:
        p.error("an import needs --name")
    if a.export and a.folder and not a.output:
        p.error("--folder needs --output")
    engine = Engine(spark or SparkSession.builder.getOrCreate(), replace(EngineConfig.from_env(), data_folder=a.data_folder))
    if a.serve:
        host, _, port = a.host.rpartition(":")
        service.server(engine, host or "127.0.0.1", int(port)).serve_forever()
        return 0
    if a.export and a.folder:
        exchange.export_folder(engine.collection(a.export, "read_only"), a.output)
        return 0
    out = open(a.output, "w") if a.output else sys.stdout
    try:
        if a.list:
            for row in engine.list_collections().collect():
                print(row.name, row.document_count, row.dimension_count, row.quantization, row.distance_method, sep="\t", file=out)
        elif a.dump:
            for row in engine.collection(a.dump, "read_only").stored_files().orderBy("file").collect():
                print(row.file, row.bytes, row.records, sep="\t", file=out)
        elif a.export:
            exchange.export_json(engine.collection(a.export, "read_only"), out)
        elif a.spans:
            spans.import_spans(engine.spark, a.data_folder, a.name, a.spans)
        elif a.folder:
            exchange.import_folder(engine.spark, a.data_folder, a.name, a.source)
        else:
            exchange.import_file(engine.spark, a.data_folder, a.name, a.source)
    finally:
        if a.output:
            out.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
