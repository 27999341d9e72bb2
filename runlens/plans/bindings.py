"""Views of the given tables in the roles that the operators expect, as the same SQL for Spark and for the oracle."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from runlens.operators import relational

TABLES = ("benchmark", "conversations", "customer", "documents", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")

#: Later views build on earlier ones. {us} is the time stamp in microseconds.
VIEWS = {
    "v_runs": "select c_custkey as run, c_mktsegment as domain, c_nationkey as nation, cast(c_custkey % 7 = 0 as boolean) as flagged from {customer}",
    "v_reqs": "select o_custkey as run, o_orderkey as req, case when o_orderpriority = '5-LOW' then 'public' else concat('owner-', substr(o_orderpriority, 1, 1)) end as holder, case o_orderstatus when 'F' then 'obtained' when 'O' then 'returned_not_visible' else 'not_disclosed' end as disclosure from {orders}",
    "v_records": "select o.o_custkey as run, l.l_orderkey as req, l.l_orderkey * 100 + l.l_linenumber as node, case l.l_linestatus when 'F' then 'f2p' else 'p2p' end as node_class, case l.l_returnflag when 'R' then 'failed' else 'passed' end as status, l.l_partkey as ord1, l.l_suppkey as ord2, l.l_extendedprice as ord3 from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey",
    "v_nodes": "select run, req, node, node_class, status from (select *, row_number() over (partition by node order by ord1, ord2, ord3) as rn from {v_records}) t where rn = 1",
    "v_turns": "select conv_id as run, turn, role, text from {conversations}",
    "v_notes": "select doc_id as run, text, lang, source as model from {documents}",
    "v_quotes": "select item_id as quote_id, text as quote from {benchmark}",
    "v_ratings": "select l.doc_id as run, l.quality as score, l.toxic as flag, d.n_chars as effort, d.source as dimension from {labels} l join {documents} d on d.doc_id = l.doc_id",
    "v_actions": "select user_id as run, event_id as action, event_type as tool, props as args, {us} as start_us, {us} + cast(floor(value * 60000000) as bigint) as end_us, event_type = 'error' as is_error, event_type = 'purchase' as is_ask, event_type = 'click' as is_edit from {events}",
    # an ask of a requirement: the next requirement of the same run, put to its holder
    "v_asks": "select run, req as ask, lead(req) over (partition by run order by req) as req, holder as recipient, req as ord from {v_reqs}",
    # reported and reconstructed pass counts per run
    "v_counts": "select run, count(case when node_class = 'f2p' then 1 end) as f2p_total, count(case when node_class = 'f2p' and status = 'passed' then 1 end) as f2p_passed, count(case when node_class = 'p2p' then 1 end) as p2p_total, count(case when node_class = 'p2p' and status = 'passed' then 1 end) as p2p_passed, count(*) as total from {v_nodes} group by run",
}
_SPARK_US, _DUCK_US = "unix_micros(cast(ts as timestamp))", "epoch_us(ts)"


class Views:
    """Lazily made views, tables included, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
            elif name in VIEWS:
                self._made[name] = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
        return self._made[name]

    def keep(self, name: str, *columns: str) -> None:
        """Writes a view that a query reads several times, and reads it back from there: else its joins and windows run, and move the records, once for each time.

        With columns, the view has only these from then on.
        """
        self._made[name] = self.written(getattr(self, name).select(*(columns or "*")), name)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Rows read back from where they were written.

        The folder is that of spark.checkpoint.dir. Without one, a local
        session has a temporary folder, and a cluster goes on with the rows as they come.
        """
        context = self._spark.sparkContext
        folder = self._spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not folder and (context.master == "local" or context.master.startswith("local[")):
            folder = tempfile.mkdtemp(prefix="spark-runlens-")
        if not folder:
            return df
        path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def written_in_place(self, df: DataFrame, name: str) -> DataFrame:
        """As ``written``, of rows that are dealt out by some columns and whose joins by these and others need not move them."""
        with relational.joined_in_place(self._spark):
            return self.written(df, name)

    def sql(self, text: str) -> DataFrame:
        used = {n: getattr(self, n) for n in (*TABLES, *VIEWS) if f"{{{n}}}" in text}
        return self._spark.sql(text.replace("{us}", _SPARK_US), **used)


def oracle(body: str) -> str:
    """``body`` with all views in front of it."""
    names = {n: n for n in (*TABLES, *VIEWS)}
    ctes = ",\n".join(f"{n} as ({v.format(us=_DUCK_US, **names)})" for n, v in VIEWS.items())
    lead = next((w for w in ("with recursive ", "with ") if body.lstrip().startswith(w)), "")
    return f"{lead}{ctes},\n{body.lstrip()[len(lead):]}" if lead else f"with {ctes}\n{body}"
