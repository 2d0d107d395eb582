"""Views over the given tables that the queries run on; one text for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings")
VIEWS = {
    "v_track": "select user_id as accession, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as pos, value as attr, event_type from events",
    "v_genome": "select accession, count(*) as n from v_track group by accession",
    "v_span": """select accession, cls, cast(floor(n*a/100.0) as int) as s0, cast(floor(n*b/100.0) as int) as s1
from v_genome cross join (values ('polymerase_replicase',10,55),('polymerase_replicase',50,70),('entry_interface',72,85),('rbd',76,80),
('accessory_immune',85,90),('structural_other',90,97)) as t(cls,a,b)""",
    "v_window": "select g.accession, i.i as window_index, cast(floor(i.i*g.n/3.0) as int) as w0, cast(floor((i.i+1)*g.n/3.0) as int) as w1 from v_genome g cross join (values (0),(1),(2)) as i(i)",
    "v_merged": """select accession, cls, min(s0) as s0, max(s1) as s1 from (select *, sum(fresh) over (partition by accession, cls order by s0, s1 rows unbounded preceding) as island
from (select *, case when max(s1) over (partition by accession, cls order by s0, s1 rows between unbounded preceding and 1 preceding) >= s0 then 0 else 1 end as fresh from v_span) x) y group by accession, cls, island""",
    "v_scored": "select w.accession, w.window_index, w.w0, w.w1, avg(abs(t.attr)) as score from v_window w join v_track t on t.accession = w.accession and t.pos >= w.w0 and t.pos < w.w1 group by w.accession, w.window_index, w.w0, w.w1",
    "v_manifest": "select d.doc_id as sequence_id, cast(l.quality as double) as label, concat(d.lang,'/',d.source) as group_id, d.source as block_id, d.n_chars, d.text from documents d join labels l on d.doc_id = l.doc_id",
    "v_emb": "select vec_id, embedding as features, cast(label as double) as y, label*3 + vec_id % 3 as group_id, label % 3 as family, label % 2 as host from embeddings",
}


def _needs(text: str, names) -> list[str]:
    return [v for v in names if re.search(rf"\b{v}\b", text)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    parts = {n: view(spark, sf_dir, n) for n in _needs(text, [*TABLES, *VIEWS]) if n != name}
    for n in parts:
        text = re.sub(rf"(from|join)\s+{n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **parts)


def ctes(sql: str) -> str:
    """The SQL with the views that it names, and those that these name, put before it."""
    wanted: list[str] = []

    def add(text):
        for n in _needs(text, VIEWS):
            if n not in wanted:
                add(VIEWS[n])
                if n not in wanted:
                    wanted.append(n)

    add(sql)
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in wanted)
    if not wanted:
        return sql
    first, own = next(((w, sql[len(w) :]) for w in ("with recursive ", "with ") if sql.startswith(w)), ("with ", None))
    return f"{first}{head} {sql}" if own is None else f"{first}{head}, {own}"
