"""A warehouse whose tables are replaced whole and at once.

A table version is a folder that is written completely before anything names it.  What readers see is
the newest manifest, ``_versions/<number>.json``: the folder of every table, with the fingerprint of
the source it was loaded from.  A load stages its folder, then adds a manifest in which the table
points to it; a load that dies at any moment leaves the manifests as they were, so the old table
stays readable and a rerun gives the same one.  Manifests are renamed into place, never changed.

:func:`refresh` loads the raw files as a graph: a table waits for the tables its foreign keys name,
independent ones load at the same time, and each is committed as soon as it is there.  The
fingerprints are the ledger: a table whose file (names, lengths and times of change) and rules have not
changed since its commit is not loaded again, so a run that was stopped goes on where it was.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession

from emporion.schemas import LOAD_ORDER, TABLES, Table
from emporion.session import drop_folder

_COMMIT = threading.Lock()  # of this driver; between drivers the file system's rename decides


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, jpath = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(jpath)] if fs.exists(jpath) else []


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the names, lengths and times of change of the files at ``path``."""
    fs, jpath = _fs(spark, path)
    found, files = fs.listFiles(jpath, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()
        if not any(p.startswith((".", "_")) for p in name.split("/")[-1:]):
            files.append((name, f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(files)).encode()).hexdigest()


class Warehouse:
    """Tables under ``root``, as the newest manifest names them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in _names(self.spark, f"{self.root}/_versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """Table name -> ``path`` (and what else was committed); empty before the first commit."""
        known = self.versions()
        if not known:
            return {}
        fs, jpath = _fs(self.spark, f"{self.root}/_versions/{version or known[-1]:08d}.json")
        stream = fs.open(jpath)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        path = self.manifest(version)[name]["path"]
        reader = self.spark.read
        if name in TABLES:
            reader = reader.schema(TABLES[name].spark_schema)
        return reader.parquet(f"{self.root}/{path}")

    def stage(self, df: DataFrame, name: str) -> str:
        """Write a version of a table that no manifest names yet; its folder, relative to the root."""
        path = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return path

    def commit(self, tables: dict[str, dict]) -> int:
        """Add a manifest with the given tables changed; the others stay as they are."""
        with _COMMIT:
            while True:
                known = self.versions()
                number = known[-1] + 1 if known else 1
                text = json.dumps(self.manifest() | tables, indent=1, sort_keys=True)
                fs, draft = _fs(self.spark, f"{self.root}/_versions/.draft-{uuid.uuid4().hex}")
                out = fs.create(draft, False)
                out.write(bytearray(text.encode()))
                out.close()
                _, final = _fs(self.spark, f"{self.root}/_versions/{number:08d}.json")
                if not fs.exists(final) and fs.rename(draft, final):
                    return number
                fs.delete(draft, False)  # another driver was first: merge with what it wrote

    def refresh_table(self, df: DataFrame, name: str, **more) -> int:
        """A2: replace a table by ``df``."""
        return self.commit({name: {"path": self.stage(df, name), **more}})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests before the last ``keep`` and the folders that none of those names.  To be
        run while nothing loads."""
        known = self.versions()
        used = {t["path"] for v in known[-keep:] for t in self.manifest(v).values()}
        gone = []
        for v in known[:-keep]:
            drop_folder(self.spark, f"{self.root}/_versions/{v:08d}.json")
        for name in _names(self.spark, self.root):
            for folder in _names(self.spark, f"{self.root}/{name}") if name != "_versions" else []:
                if f"{name}/{folder}" not in used:
                    drop_folder(self.spark, f"{self.root}/{name}/{folder}")
                    gone.append(f"{name}/{folder}")
        return gone


def parents(meta: Table) -> set[str]:
    return {parent for _, parent, _ in meta.foreign_keys} - {meta.name}


def refresh(spark: SparkSession, raw_dir: str, root: str, raw_files: dict[str, str] | None = None,
            patch: list[tuple[str, str]] | None = None, quarantine: bool = False, parallelism: int = 4) -> dict[str, str]:
    """A3: bring the warehouse at ``root`` up to date with the raw files; what became of each table:
    ``loaded``, ``unchanged``, ``blocked`` (a table it refers to failed) or ``failed: ...``.

    With ``quarantine`` records that break a rule of the registry do not fail the load: they are left
    out and listed in the table ``quarantine_<name>`` (see ``csv_io.read_checked_csv``)."""
    from emporion.sources.csv_io import read_checked_csv, read_for_load

    house = Warehouse(spark, root)
    ledger = house.manifest()

    def load(name: str) -> str:
        meta = TABLES[name]
        src = f"{raw_dir.rstrip('/')}/{(raw_files or {}).get(name, meta.raw_file)}"
        rules = hashlib.sha256(repr((meta, patch if name == "dim_product_category_translation" else None, quarantine)).encode()).hexdigest()
        source = {"file": src, "fingerprint": fingerprint(spark, src), "rules": rules}
        if ledger.get(name, {}).get("source") == source:
            return "unchanged"
        if quarantine:
            df, bad = read_checked_csv(spark, src, name, for_load=True, patch=patch)
            tables = {f"quarantine_{name}": {"path": house.stage(bad, f"quarantine_{name}")}}
        else:
            df, tables = read_for_load(spark, src, name, patch), {}
        house.commit(tables | {name: {"path": house.stage(df, name), "source": source}})
        return "loaded"

    said: dict[str, str] = {}
    left, running = list(LOAD_ORDER), {}
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        while left or running:
            for name in [n for n in left if all(p in said for p in parents(TABLES[n]))]:
                left.remove(name)
                if any(said[p] == "blocked" or said[p].startswith("failed") for p in parents(TABLES[name])):
                    said[name] = "blocked"
                else:
                    running[pool.submit(load, name)] = name
            if not running:
                continue
            for done in wait(running, return_when=FIRST_COMPLETED).done:
                name, error = running.pop(done), done.exception()
                if error is not None and not isinstance(error, Exception):
                    raise error
                said[name] = f"failed: {str(error).splitlines()[0][:300]}" if error else done.result()
    return {name: said[name] for name in LOAD_ORDER}
