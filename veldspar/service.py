"""The engine over HTTP: JSON requests under /api/v1/collections.

``handle`` answers one request and knows nothing of sockets; ``serve`` puts it behind the
standard library's server. Searches run as Spark jobs, at once if they come at once.

    POST   /api/v1/collections                       name, vector_size, quantization, distance_function
    GET    /api/v1/collections                       all collections' statistics
    GET    /api/v1/collections/<name>                one collection's statistics
    GET    /api/v1/collections/<name>/ids            the ids of its records
    DELETE /api/v1/collections/<name>
    POST   /api/v1/collections/<name>/records        a list of {id, vector or text, metadata}
    PUT    /api/v1/collections/<name>/records/<id>/metadata   {metadata}
    DELETE /api/v1/collections/<name>/records/<id>
    GET, POST  /api/v1/collections/<name>/search     vector, text, k, radius, limit, offset, precision, filter
"""

from __future__ import annotations

import gzip
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .collection import Collection
from .engine import Engine
from .filters import FilterSyntaxError

ROOT = ["api", "v1", "collections"]
STATISTICS = ("name", "document_count", "dimension_count", "quantization", "distance_method", "storage_size", "average_distance")
SEARCH = {"vector": list, "text": str, "k": int, "radius": float, "limit": int, "offset": int, "precision": str, "filter": str}


class Refused(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


def _decoded(body: bytes):
    try:
        return json.loads(body)
    except ValueError:
        raise Refused(400, "the body isn't JSON") from None


def _object(found) -> dict:
    if not isinstance(found, dict):
        raise Refused(400, "the body isn't a JSON object")
    return found


def _statistics(row) -> dict:
    return {name: row[name] for name in STATISTICS}


def _create(engine: Engine, asked: dict) -> tuple[int, dict]:
    name, size = asked.get("name"), asked.get("vector_size")
    if not isinstance(name, str) or not isinstance(size, int):
        raise Refused(400, "a collection needs a name and a vector_size")
    try:
        engine.create_collection(name, size, asked.get("quantization") or 64, asked.get("distance_function"))
    except ValueError as problem:
        raise Refused(400, str(problem)) from None
    return 201, {"message": "The collection is there.", "collection_name": name}


def _insert(collection: Collection, records) -> tuple[int, dict]:
    if not isinstance(records, list) or not all(isinstance(r, dict) and isinstance(r.get("id"), int) for r in records):
        raise Refused(400, "records are a list of objects with an id")
    try:
        collection.upsert([{k: r.get(k) or None for k in ("vector", "text")} | {"id": r["id"], "metadata": json.dumps(r.get("metadata"))} for r in records])
    except (ValueError, TypeError) as problem:
        raise Refused(400, str(problem)) from None
    return 201, {"message": f"{len(records)} records are there."}


def search_arguments(asked: dict) -> dict:
    """Arguments of Collection.search from those of a request, which may be texts; what is
    empty counts as not given."""
    found = {}
    for name, kind in SEARCH.items():
        value = asked.get(name)
        if value in (None, "", []):
            continue
        try:
            found[name] = [float(x) for x in value] if kind is list else kind(value)
        except (TypeError, ValueError):
            raise Refused(400, f"{name} can't be {value!r}") from None
    return found


def _search(collection: Collection, asked: dict) -> tuple[int, dict]:
    try:
        return 200, collection.search(**search_arguments(asked)).response()
    except (FilterSyntaxError, ValueError) as problem:
        raise Refused(400, str(problem)) from None


def _number(text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise Refused(400, "a record's id is a number")
    return int(text)


def _answer(engine: Engine, method: str, parts: list[str], query: dict[str, str], body: bytes) -> tuple[int, object]:
    if parts[:3] != ROOT:
        raise Refused(404, "there is nothing here")
    match method, *parts[3:]:
        case ["POST"]:
            return _create(engine, _object(_decoded(body)))
        case ["GET"]:
            return 200, [_statistics(r) for r in engine.list_collections().collect()]
        case ["DELETE", name]:
            return 200, {"message": "The collection is gone." if engine.drop_collection(name) else "There was no such collection."}
    if len(parts) < 4 or parts[3] not in engine:
        raise Refused(404, "there is no such collection")
    collection = engine.collection(parts[3])
    try:
        match method, *parts[4:]:
            case ["GET"]:
                return 200, _statistics(collection.stats(seed=engine.config.random_seed).first())
            case ["GET", "ids"]:
                return 200, [r.id for r in collection.ids().collect()]
            case ["POST", "records"]:
                return _insert(collection, _decoded(body))
            case ["PUT", "records", number, "metadata"]:
                collection.update_metadata(_number(number), json.dumps(_object(_decoded(body)).get("metadata")))
                return 200, {"message": "The metadata is replaced.", "id": int(number)}
            case ["DELETE", "records", number]:
                collection.remove_document(_number(number))
                return 200, {"message": "The record is gone.", "id": int(number)}
            case ["GET", "search"]:
                return _search(collection, query)
            case ["POST", "search"]:
                return _search(collection, _object(_decoded(body)))
    except KeyError:
        raise Refused(404, "there is no such record") from None
    raise Refused(405, "this can't be done here")


def handle(engine: Engine, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
    """(status, what to answer as JSON) of a request; errors are {"error": message}."""
    url = urlsplit(target)
    parts = [unquote(p) for p in url.path.split("/") if p]
    try:
        return _answer(engine, method, parts, {k: v[-1] for k, v in parse_qs(url.query).items()}, body)
    except Refused as refused:
        return refused.status, {"error": str(refused)}


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _do(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, found = handle(engine, self.command, self.path, body)
            except Exception as problem:  # noqa: BLE001 - a failed job must not end the service
                status, found = 500, {"error": str(problem).split("\n")[0]}
            data = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            if "gzip" in self.headers.get("Accept-Encoding", "") and len(data) > 1000:
                data = gzip.compress(data)
                self.send_header("Content-Encoding", "gzip")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _do

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
