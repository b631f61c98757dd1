"""E16 between runs (A6): a ledger of digests, so that a rerun skips steps whose inputs are unchanged.

A step's inputs are the tables that it reads; running it notes them with their
digests (one aggregate a table version). Before a later run, the digests of those
tables as they stand then, and the parameters, give the step's input key. If the
ledger holds that key, the step is skipped and its stored versions stand; else it
runs and its outputs are stored anew. A changed table thus reruns the steps that
read it and, as far as their outputs differ, those after them. The ledger is a
small table (one row a step) in the same folder as the versions; it is replaced
only after all outputs of a run are written.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from spooltrace.plans import etl as E
from spooltrace.sources.staging import content_digest

LEDGER = "step string, input_key string, inputs array<string>, outputs array<string>, version string"


class Recorder(E.Versions):
    """Versions in a folder; notes which tables a step reads, with their digests before it changes them."""

    def __init__(self, db, folder: str):
        super().__init__(db)
        self.__dict__.update(_folder=folder, _step="", _version="", _inputs={}, _outputs=[], _digests={}, _prints_read=set())

    def begin(self, step: str) -> None:
        self.__dict__.update(_step=step, _version=uuid.uuid4().hex, _inputs={}, _outputs=[])

    def __getattr__(self, name):
        value = super().__getattr__(name)
        if isinstance(value, DataFrame):
            self._note(name)
        return value

    def _note(self, name: str) -> None:
        if name not in self._inputs and name not in self._outputs:  # what the step itself has written is no input
            self._inputs[name] = self.digest(name)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{self._step}/{name}/{self._version}"
        df.write.parquet(path)
        self._outputs.append(name)
        return self.lay(name, df.sparkSession.read.schema(df.schema).parquet(path))

    def lay(self, name: str, df: DataFrame) -> DataFrame:
        """A stored version over the tables."""
        if name == "storage_locations":
            self.__dict__.pop("_ensured_locations", None)
        self._digests.pop(name, None)
        self._new[name] = df
        return df

    def prints(self, cutoff: str) -> DataFrame:
        if "_prints" not in self.__dict__:
            outer = self._inputs
            self.__dict__["_inputs"] = {}
            super().prints(cutoff)
            self._prints_read.update(self._inputs)
            self.__dict__["_inputs"] = outer
        for name in self._prints_read:  # whoever uses them depends on what they were made from
            self._note(name)
        return self.__dict__["_prints"]

    def digest(self, name: str) -> list:
        if name not in self._digests:
            table = E.Versions.__getattr__(self, name)
            self._digests[name] = [name, table.schema.simpleString(), *content_digest(table).first()]
        return self._digests[name]


def read_ledger(spark: SparkSession, folder: str) -> dict:
    """The ledger's row of each step; empty before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    return {r.step: r for r in spark.read.schema(LEDGER).parquet(f"{folder}/ledger").collect()}


def run_changed(db, folder: str, cutoff: str, as_of: str) -> tuple[dict[str, DataFrame], list[str]]:
    """All steps of E16 against the ledger in ``folder``: (the table versions, the steps that ran)."""
    spark = db.spark
    known = read_ledger(spark, folder)
    v = Recorder(db, folder)
    ran, entries = [], []

    def key(digests: list[list]) -> str:
        return hashlib.sha256(json.dumps([cutoff, as_of, *sorted(digests)]).encode()).hexdigest()

    for step, run in E.PIPELINE_STEPS.items():
        old = known.get(step)
        if old and key([v.digest(name) for name in old.inputs]) == old.input_key:
            for name in old.outputs:
                v.lay(name, spark.read.parquet(f"{folder}/{step}/{name}/{old.version}"))
            entries.append(tuple(old))
            continue
        v.begin(step)
        run(v, cutoff, as_of)
        ran.append(step)
        entries.append((step, key(list(v._inputs.values())), sorted(v._inputs), list(dict.fromkeys(v._outputs)), v._version))
    if ran:
        spark.createDataFrame(entries, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger")
    return v.written(), ran


def ledger_digests(db, versions: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows, hash_sum, hash_xor) of the versions that a run stands on."""
    out = None
    for name in sorted(versions):
        row = content_digest(versions[name]).selectExpr(f"'{name}' AS table_name", "*")
        out = row if out is None else out.unionByName(row)
    return out
