
from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from treegate import naive, parse  # noqa: E402
from treegate.automaton import Automaton  # noqa: E402
from treegate.catalogue import QUERIES  # noqa: E402
from treegate.errors import RecordError  # noqa: E402
from treegate.sources import jsontree  # noqa: E402


def best(run, times: int = 5) -> float:
    took = []
    for _ in range(times + 1):
        started = time.perf_counter()
        run()
        took.append(time.perf_counter() - started)
    return min(took[1:])


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    lineitem, events, embeddings = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "events", "embeddings"))
    count = lambda df: df.agg(F.count("*")).collect()

    def report(what: str, rows: int, seconds: float) -> None:
        print(f"{what}: {seconds:.3f} s, {rows / seconds:,.0f} rows/s")

    n = lineitem.count()
    grammar = parse('(.l_returnflag == "R" & .l_quantity > double(45))')
    report("typed predicate", n, best(lambda: count(grammar.filter(lineitem))))
    report("hand-written filter", n, best(lambda: count(lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)))))
    n = events.count()
    grammar = parse("!(.k > 50)")
    report("JSON by the automaton, 8 tasks asked for", n, best(lambda: count(grammar.filter(events.repartition(8), on="props", format="json"))))
    report("JSON by the automaton, as read", n, best(lambda: count(grammar.filter(events, on="props", format="json"))))
    texts = [r.props for r in events.select("props").limit(20_000).collect()]
    forests = [jsontree.decode(t) for t in texts]

    def plain() -> None:
        for f in forests:
            try:
                naive.derive(grammar.compiled, f)
            except RecordError:
                pass

    machine = Automaton(grammar.compiled)
    report("decoding alone, one core", len(texts), best(lambda: [jsontree.decode(t) for t in texts], 2))
    report("derivatives, one core", len(texts), best(plain, 2))
    report("automaton, one core, warm", len(texts), best(lambda: [machine.accepts(f) for f in forests], 2))
    started = time.perf_counter()
    Automaton(grammar.compiled).accepts(forests[0])
    print(f"automaton, first record cold: {(time.perf_counter() - started) * 1e6:.0f} us")
    n = embeddings.count()
    grammar = parse(".embedding:(_:->lt($double, double(0.2)))*")
    report("array pattern as a predicate", n, best(lambda: count(grammar.filter(embeddings))))
    slow = embeddings.filter(grammar.plan(embeddings, how="automaton").column)
    report("array pattern by the automaton", n, best(lambda: count(slow)))
    started = time.perf_counter()
    made = [f(spark, sf_dir) for name, f in QUERIES.items() if name != "streaming"]
    print(f"{len(made)} grammars parsed, compiled and analysed: {(time.perf_counter() - started) / len(made) * 1e3:.1f} ms each")


if __name__ == "__main__":
    main()
