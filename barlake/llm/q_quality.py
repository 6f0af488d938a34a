"""op3: counts and risk-controlled verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.llm.quality import PRICE, RULES, Risk, quality_rules
from barlake.llm.text import read_table

RISK = Risk(alpha=0.05, delta=0.10)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), risk=RISK)


_P = RISK.alpha / len(RULES)
_STATS = "\n  union all ".join(
    f"select doc_id, stratum, quality, '{r}' as rule, ({sql.replace('div', '//')})::int as s from labelled" for r, sql in RULES.items())
_REJECTS = " ".join(f"when ({sql.replace('div', '//')}) >= cut_{r} then '{r}'" for r, sql in RULES.items())
_CUTS = ", ".join(f"max(cutoff) filter (rule = '{r}') as cut_{r}" for r in RULES)

SQL = rf"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
grams as (select doc_id, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] as g from d, unnest(range(1, len(ws) - 1)) as t(k)),
rep as (select doc_id, k from (select doc_id, k, count(*) over (partition by doc_id, g) as c from grams) where c > 1),
cov as (select doc_id, count(distinct k + j) as n from rep, unnest(range(0, 3)) as t(j) group by doc_id),
f as (select doc_id, stratum, len(ws)::bigint as n_words, length(list_aggregate(ws || [''], 'string_agg', ''))::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             (len(list_filter(str_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(str_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::bigint as n_dup_lines,
             coalesce(n, 0)::bigint as n_repeat_words
      from d left join cov using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
m as (select doc_id, min(quality) as quality from labels where quality in (0, 1) group by doc_id),
labelled as (select * from b join m using (doc_id) where not base_failed),
stats as ({_STATS}),
cells as (select stratum, rule, s, count(*) filter (quality = 1) as good, count(*) filter (quality = 0) as bad from stats group by all),
n as (select stratum, rule, sum(good) as n, sum(bad) as n_bad from cells group by all),
grid as (select n.*, t.s, coalesce(good, 0) as good, coalesce(bad, 0) as bad
         from n cross join unnest(range(1, 64)) as t(s) left join cells on cells.stratum = n.stratum and cells.rule = n.rule and cells.s = t.s),
above as (select *, sum(good) over c as k, sum(bad) over c as k_bad from grid window c as (partition by stratum, rule order by s desc)),
tested as (select *, k < n * {_P!r} and (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P!r}) + (n - i) * ln(1 - {_P!r})))
                     from unnest(range(0, k::bigint + 1)) as t(i)) <= {RISK.delta!r} / (select count(*) from n) as ok from above),
chain as (select *, bool_and(ok) over (partition by stratum, rule order by s desc) as certified,
                 k_bad / greatest(n_bad, 1) - {PRICE} * k / greatest(n, 1) as gain from tested),
best as (select stratum, rule, arg_max(s, (gain, s)) as cutoff, max(gain) as gain from chain where certified group by all having max(gain) > 0),
cuts as (select stratum, {_CUTS} from best group by stratum),
judged as (select b.*, case when base_failed then null {_REJECTS} end as rule from b left join cuts using (stratum))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rule is null as kept, rule from judged
"""

QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": SQL}
