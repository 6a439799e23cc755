"""Queries of the problems of TESTDATA.md, and SQL for those that it can express."""

from __future__ import annotations

from codelens.llm.containers import containers
from codelens.llm.foreign import p3_found, p3_mined
from codelens.llm.grams import p2_found, p2_frequencies
from codelens.llm.leaks import p9_found
from codelens.llm.licences import p5_found
from codelens.llm.personal import p10_found, p10_masked
from codelens.llm.prose import p6_found, p6_shares, p7_found
from codelens.llm.secrets import p4_found, p4_masked
from codelens.llm.syntax import p1_faults, p1_found, p1_rates

QUERIES = {
    "p1_found": p1_found,
    "p1_faults": p1_faults,
    "p1_rates": p1_rates,
    "p2_found": p2_found,
    "p2_frequencies": p2_frequencies,
    "p3_found": p3_found,
    "p3_mined": p3_mined,
    "p4_found": p4_found,
    "p4_masked": p4_masked,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_shares": p6_shares,
    "p7_found": p7_found,
    "p8_containers": containers,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_masked": p10_masked,
}

P2_SQL = """
with o as (
    select distinct translate(gram, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') gram, doc_id, unnest(coalesce(locations, [null])) loc from postings
), g as (
    select gram, count(loc) occurrences, count(distinct case when loc is not null then doc_id end) documents from o where gram is not null and doc_id is not null group by gram
), m as (
    select gram, case when occurrences <= 2 then 'rare' when documents >= 0.6 * (select count(distinct doc_id) from postings) then 'common' end mark from g
)
select gram, mark from m where mark is not null
"""

P2_ALL = P2_SQL.replace("select gram, mark from m where mark is not null", "select * from m").replace("as (\n    select gram, case", "as (\n    select gram, occurrences, documents, case")

SQL = {"p2_found": P2_SQL, "p2_frequencies": P2_ALL}
