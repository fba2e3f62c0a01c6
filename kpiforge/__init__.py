"""kpiforge: departmental decision-support analytics as Spark DataFrame jobs.

Layout
------
functions/  column-level helpers (dates, numbers, text)            -> FN*
operators/  table-in/table-out operators (derive, aggregate, top-k,
            joins, insights, what-if)                               -> PRJ*, AG*, SO*, JN*, WI*
sources/    CSV/Parquet department readers, bindings to the test
            star schema, stored summaries, dataset intake           -> SRC*
sinks/      summary/report/prediction/audit/model writers           -> SNK*
plans/      department packs (HR, IT, production, sales, supply
            chain, transport, marketing), summary assembly and the
            query catalog used by ``__spark_entry__``               -> HR*, IT*, ...
ml/         Spark ML jobs: encoding, scaling, hash split, forests,
            k-means, oversampling, metrics                          -> ML*
streaming/  Structured Streaming intake of uploaded datasets
"""

__version__ = "0.1.0"
