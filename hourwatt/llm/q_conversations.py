"""Registered query: conversation repair, on conversations damaged by a fixed rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwatt.llm.conversation_repair import digests, repair
from hourwatt.llm.registry import query, table

# What the remainder of crc32("conv_id:turn") by 20 does to a row.
DROP, EMPTY, UNSTOP, REPEAT, TO_USER = range(5)
SQL = """
with recursive t256 as (select [list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
    for x in generate_series(0, 255)] as t),
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as txt,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key, dense_rank() over (order by conv_id) as c from conversations),
dealt as (select *, xor(list_reduce(list_prepend(4294967295, [ascii(key[i])::bigint for i in generate_series(1, length(key))]),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as k from keyed, t256),
damaged as (select c, turn, case k when 4 then 'user' else role end as role,
    case k when 1 then '' when 2 then translate(txt, '.!?', '') else txt end as txt, unnest(case when k = 3 then [1, 2] else [1] end) as copy from dealt where k > 0),
placed as (select *, row_number() over (partition by c order by turn nulls first, role, txt) as i, role[1] as ini from damaged),
marked as (select *, not regexp_matches(txt, '[^\\x20\\x09-\\x0D]') as blank, row_number() over (partition by c, role, txt order by i) > 1 as again,
    rtrim(txt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1] not in ('.', '!', '?') as cut,
    lag(ini) over (partition by c order by i) || ini as two from placed),
lines as (select c, i, turn, ini, role, txt, two, blank, again and not blank as dup, cut and not blank and not again as trunc from marked),
ins(s, n, t, added) as (values (0, 0, 0, []), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']),
    (1, 2, 3, ['user:', 'assistant:']), (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']),
    (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])),
edits(s, edit, ini, t) as (values (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2),
    (0, 'R', null, 2), (1, 'R', null, 2), (2, 'R', null, 3), (3, 'R', null, 2), (0, 'D', null, 0), (1, 'D', null, 1), (2, 'D', null, 2), (3, 'D', null, 3)),
path as (
  select distinct c, 0::bigint as i, 0 as s, {'cost': 0, 'audit': '', 'out': []::varchar[]} as best from lines
  union all
  select l.c, l.i, e.t, min({'cost': p.best.cost + 2 * ins.n + case e.edit when 'D' then 3 when 'R' then 2 + l.trunc::int else l.trunc::int end,
      'audit': p.best.audit || repeat('I', ins.n) || e.edit,
      'out': p.best.out || ins.added::varchar[] || case e.edit when 'D' then []::varchar[] when 'K' then [l.role || ':' || l.txt]
        else [case e.t when 2 then 'user' else 'assistant' end || ':' || l.txt] end})
  from path p join lines l on l.c = p.c and l.i = p.i + 1 join ins on ins.s = p.s
  join edits e on e.s = ins.t and (e.ini is null or e.ini = l.ini) and (e.edit = 'D' or not (l.blank or l.dup))
  group by l.c, l.i, e.t),
sizes as (select c, max(i) as n, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (trunc) as truncated,
    count(*) filter (two not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from lines group by c),
final as (select p.c, min({'cost': p.best.cost + 2 * ins.n, 'audit': p.best.audit || repeat('I', ins.n), 'out': p.best.out || ins.added::varchar[]}) as best
  from path p join sizes on sizes.c = p.c and p.i = sizes.n join ins on ins.s = p.s and ins.t in (0, 3) group by p.c)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.out, chr(10)), '')) as repaired_sha256
from (select distinct conv_id, c from keyed) o left join sizes using (c) left join final using (c)
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fifth of their rows spoilt by a rule that depends on id and turn alone; nulls are one space."""

    def shown(column):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    role = F.when(F.col("kind") == TO_USER, "user").otherwise(shown("role"))
    text = F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == UNSTOP, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.explode(F.when(F.col("kind") == REPEAT, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.withColumn("kind", kind).where(F.col("kind") != DROP).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))


@query("op11_conversation_repair", SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damaged(rows))
    ids = rows.select("conv_id").distinct()
    found = done.conversations.alias("c")
    turned = digests(done.turns).alias("d")
    joined = ids.alias("i").join(found, F.col("i.conv_id").eqNullSafe(F.col("c.conv")), "left").join(turned, F.col("i.conv_id").eqNullSafe(F.col("d.conv")), "left")
    counts = [F.coalesce(F.col(f"c.{k}"), F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("i.conv_id", *counts, F.coalesce("c.audit", F.lit("")).alias("audit"), F.coalesce("d.sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
