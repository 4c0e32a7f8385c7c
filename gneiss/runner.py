"""Command line: run the queries over a table, show what they scan, import and export CSV.

    python -m gneiss.runner run TABLE OUT_DIR [NUMBER ...]
    python -m gneiss.runner one INDEX TABLE OUTPUT_CSV LOG_FILE
    python -m gneiss.runner explain [NUMBER ...]
    python -m gneiss.runner convert CSV [TABLE [SCHEMA_FILE]]
    python -m gneiss.runner export TABLE CSV_DIR
"""

from __future__ import annotations

import csv
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from gneiss import schema, session
from gneiss.plans import hits
from gneiss.sources import csvfiles

SUMMARY = ["query", "status", "rows", "query_ms", "write_ms", "total_ms", "file", "read_ms", "error"]
#: The columns of the summary that single runs append to (fixed values).
SINGLE = ["query_index", "clickbench_query", "status", "runner_exit_code", "rows", "query_ms", "read_ms", "write_ms", "runner_total_ms", "wall_ms", "output_bytes", "output", "log", "error"]


def scanned(df: DataFrame) -> tuple[str, list[str]]:
    """The kind of table that a plan scans, and the sorted columns of it that the plan's nodes refer to."""
    leaf_kinds, own, used = set(), {}, set()

    def walk(plan) -> None:
        children = plan.children()
        if not children.size():
            leaf_kinds.add(plan.nodeName().split(" ")[0])
            own.update({plan.output().apply(k).exprId().id(): plan.output().apply(k).name() for k in range(plan.output().size())})
            return
        refs = plan.references().iterator()
        while refs.hasNext():
            used.add(refs.next().exprId().id())
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().analyzed())
    return "|".join(sorted(leaf_kinds)), sorted(own[i] for i in used & own.keys())


def read_ms(df: DataFrame) -> int:
    """Milliseconds that scans took, over all tasks, as counted by the plan that ran."""
    def leaves(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan = plan.executedPlan()
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            plan = plan.plan()
        children = plan.children()
        if not children.size():
            yield plan
        for i in range(children.size()):
            yield from leaves(children.apply(i))

    found = (leaf.metrics().get("scanTime") for leaf in leaves(df._jdf.queryExecution().executedPlan()))
    return sum(int(m.get().value()) for m in found if m.isDefined())


def run(spark: SparkSession, table: str, out_dir: str, numbers: list[int] | None = None, constants: hits.Constants = hits.Constants()) -> list[dict]:
    """A CSV file per query and summary.csv; a query that fails is recorded, and the others run."""
    os.makedirs(out_dir, exist_ok=True)
    df = spark.read.parquet(table)
    summary = []
    for n, query in hits.queries(constants).items():
        if numbers and n not in numbers:
            continue
        row = dict.fromkeys(SUMMARY, 0) | {"query": n, "status": "ok", "file": f"q{n}.csv", "error": ""}
        began = time.monotonic()
        try:
            result = query(df)
            rows = result.collect() if n not in (20,) else None
            row["query_ms"] = round(1000 * (time.monotonic() - began), 3)
            path, wrote = os.path.join(out_dir, row["file"]), time.monotonic()
            if rows is None:  # the one result without a bound
                row["rows"] = csvfiles.write_csv_file(result, path)
            else:
                row["rows"] = len(rows)
                with open(path, "w", encoding="utf-8", newline="") as f:
                    f.writelines(csvfiles.csv_lines(result.columns, rows))
            row["write_ms"] = round(1000 * (time.monotonic() - wrote), 3)
            row["read_ms"] = read_ms(result)
        except Exception as e:
            row |= {"status": "error", "file": "", "error": (str(e).splitlines() or [type(e).__name__])[0][:300]}
        row["total_ms"] = round(1000 * (time.monotonic() - began), 3)
        summary.append(row)
    with open(os.path.join(out_dir, "summary.csv"), "w", encoding="utf-8", newline="") as f:
        writer = csv.DictWriter(f, SUMMARY, lineterminator="\n")
        writer.writeheader()
        writer.writerows(summary)
    return summary


def run_one(spark: SparkSession, index: int, table: str, output: str, log: str, constants: hits.Constants = hits.Constants()) -> dict:
    """The query of a number from 0 on: its CSV, a log, and a row appended to summary.csv beside the CSV.

    A query that there is not, or that fails, leaves an empty CSV; its status is ``unsupported`` or ``error``.
    """
    folder = os.path.dirname(os.path.abspath(output))
    for made in (folder, os.path.dirname(os.path.abspath(log))):
        os.makedirs(made, exist_ok=True)
    number, began = index + 1, time.time()
    with tempfile.TemporaryDirectory() as work:
        row = dict.fromkeys(SUMMARY, 0) | {"status": "unsupported", "error": ""}
        if number in hits.queries(constants):
            try:
                (row,) = run(spark, table, work, [number], constants)
            except Exception as e:  # the table can't be read
                row |= {"status": "error", "error": (str(e).splitlines() or [type(e).__name__])[0][:300]}
        if row["status"] == "ok":
            shutil.move(os.path.join(work, row["file"]), output)
        else:
            open(output, "w").close()
    ended = time.time()
    failed = int(row["status"] == "error")
    single = {k: row[k] for k in ("status", "rows", "query_ms", "read_ms", "write_ms", "error")} | {
        "query_index": index, "clickbench_query": number, "runner_exit_code": failed, "runner_total_ms": row["total_ms"], "wall_ms": round(1000 * (ended - began)),
        "output_bytes": os.path.getsize(output), "output": output, "log": log,
    }
    with open(log, "w", encoding="utf-8") as f:
        f.write(f"phase=query\nquery_index={index}\nclickbench_query={number}\ntable={table}\noutput={output}\nstart_epoch_ms={round(1000 * began)}\n")
        f.write(f"status={single['status']}\nrunner_exit_code={failed}\nfinish_epoch_ms={round(1000 * ended)}\nerror={single['error']}\n")
    summary = os.path.join(folder, "summary.csv")
    new = not os.path.exists(summary)
    with open(summary, "a", encoding="utf-8", newline="") as f:
        writer = csv.DictWriter(f, SINGLE, lineterminator="\n")
        if new:
            writer.writeheader()
        writer.writerow(single)
    return single


def explain(spark: SparkSession, table: str | None = None, numbers: list[int] | None = None) -> list[tuple]:
    """(query, scan, number of columns, columns joined by |) of each query."""
    df = spark.read.parquet(table) if table else spark.createDataFrame([], schema.hits_schema())
    out = []
    for n, query in hits.queries(hits.Constants()).items():
        if not numbers or n in numbers:
            kind, names = scanned(query(df))
            out.append((n, kind, len(names), "|".join(names)))
    return out


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes under a path, in whatever store holds it; 0 if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getContentSummary(p).getLength() if store.exists(p) else 0


def convert(spark: SparkSession, source: str, target: str | None = None, schema_file: str | None = None, multi_line: bool = True) -> dict:
    """CSV to Parquet, by a schema file or as hits, by default beside the source; what was read and written.
    multi_line: cells may hold line breaks, so a file is read by one task."""
    target = target or os.path.splitext(source.rstrip("/"))[0] + ".parquet"
    began = time.monotonic()
    csvfiles.csv_to_table(spark, source, schema.load_schema(spark, schema_file) if schema_file else schema.hits_schema(), target, multi_line=multi_line)
    return {"status": "ok", "input_bytes": size_of(spark, source), "output_bytes": size_of(spark, target), "total_ms": round(1000 * (time.monotonic() - began), 3), "file": target}


def main(args: list[str]) -> int:
    if not args or args[0] not in ("run", "one", "explain", "convert", "export"):
        print(__doc__)
        return 2
    spark = session.get_or_create()
    spark.sparkContext.setLogLevel("ERROR")
    command, *rest = args
    if command == "run":
        summary = run(spark, rest[0], rest[1], [int(x) for x in rest[2:]])
        print(",".join(SUMMARY))
        for row in summary:
            print(",".join(str(row[k]) for k in SUMMARY))
        return int(any(r["status"] != "ok" for r in summary))
    if command == "one":
        index, table, output, log = rest
        return run_one(spark, int(index), table, output, log)["runner_exit_code"]
    if command == "explain":
        print("query,scan,columns_count,columns")
        for row in explain(spark, numbers=[int(x) for x in rest]):
            print(",".join(map(str, row)))
    elif command == "convert":
        done = convert(spark, *rest)
        print(",".join(done), ",".join(map(str, done.values())), sep="\n")
    else:
        csvfiles.table_to_csv(spark, rest[0], rest[1])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
