"""Operations by name and resources by path over a catalog; both take further ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.operators import changelog, search
from tidemark.sources.catalog import DEFAULT, Catalog


class TableResource:
    """A table at a path: get by target, post (insert), put (upsert), patch and delete of rows; subclasses override any.

    Writes give the table as it is then and leave it so in the catalog.
    """

    def __init__(self, catalog: Catalog, table: str, database: str = DEFAULT):
        self.catalog, self.name, self.database = catalog, table, database

    @property
    def rows(self) -> DataFrame:
        return self.catalog.table(self.name, self.database)

    @property
    def key(self) -> str:
        return self.catalog.key(self.name, self.database)

    def get(self, target: str = "/") -> DataFrame:
        return search.rest(self.rows, self.key, target)

    def post(self, records: DataFrame) -> DataFrame:
        """Adds records whose keys aren't there; others are refused."""
        new, _ = changelog.inserts(records, self.rows, self.key)
        return self.catalog.replace(self.name, self.rows.unionByName(new, allowMissingColumns=True), self.database)

    def put(self, records: DataFrame) -> DataFrame:
        return self.catalog.replace(self.name, changelog.upserts(self.rows, records, self.key), self.database)

    def patch(self, records: DataFrame) -> DataFrame:
        return self.catalog.replace(self.name, changelog.updates(self.rows, records, self.key), self.database)

    def delete(self, ids: DataFrame) -> DataFrame:
        return self.catalog.replace(self.name, changelog.deletes(self.rows, ids, self.key), self.database)


class Operations:
    """What a request (a dict with `operation`) stands for, as a DataFrame."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        by_id = lambda r: search.search_by_id(self._rows(r), self._key(r), r.get("ids") or r.get("hash_values"), r.get("get_attributes"))
        resource = lambda r: TableResource(catalog, r["table"], r.get("database", DEFAULT))
        self.known: dict[str, Callable[[dict], DataFrame]] = {
            "search_by_id": by_id,
            "search_by_hash": by_id,
            "search_by_value": lambda r: search.search_by_value(self._rows(r), r["attribute"], r["value"], r.get("get_attributes")),
            "search_by_conditions": lambda r: search.search(self._rows(r), r, self._key(r)),
            "sql": lambda r: catalog.sql(r["sql"]),
            "describe_all": lambda r: catalog.describe_all(),
            "describe_table": lambda r: catalog.describe_table(r["table"], r.get("database", DEFAULT)),
            "insert": lambda r: resource(r).post(r["records"]),
            "upsert": lambda r: resource(r).put(r["records"]),
            "update": lambda r: resource(r).patch(r["records"]),
            "delete": lambda r: resource(r).delete(r["ids"]),
            "clear_table": lambda r: catalog.clear(r["table"], r.get("database", DEFAULT)),
        }

    def _rows(self, request: dict) -> DataFrame:
        return self.catalog.table(request["table"], request.get("database", DEFAULT))

    def _key(self, request: dict) -> str:
        return self.catalog.key(request["table"], request.get("database", DEFAULT))

    def register(self, name: str, run: Callable[[dict], DataFrame]) -> None:
        """Adds an operation, or puts it in another's place."""
        self.known[name] = run

    def __call__(self, request: dict) -> DataFrame:
        if request.get("operation") not in self.known:
            raise ValueError(f"no operation {request.get('operation')!r}")
        return self.known[request["operation"]](request)


class Resources:
    """Resources by path: `/path/target`, method by method."""

    def __init__(self):
        self.at: dict[str, object] = {}

    def register(self, path: str, resource) -> None:
        self.at[path.strip("/")] = resource

    def __call__(self, method: str, url: str, body: DataFrame | None = None) -> DataFrame:
        first, slash, rest = url.strip("/").partition("/")
        name, mark, query = first.partition("?")
        run = getattr(self.at.get(name), method.lower(), None)
        if run is None:
            raise ValueError(f"nothing answers {method} {url}")
        return run(f"/{rest}" if slash else f"/{mark}{query}") if body is None else run(body)
