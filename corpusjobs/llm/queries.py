"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP7_SQL, op7_chat
from .decontam import op2_decontamination
from .html_text import op6_html
from .jaccard import op8_jaccard
from .media import op3_media
from .packing import op4_packing
from .quality import op10_quality
from .spelling import op13_spelling
from .suffix_tree import op9_suffix_tree
from .tokens import op11_tokens
from .toxicity import op1_toxicity
from .warc import op5_warc
from .winnowing import op12_winnowing

OP2_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bi as (select item_id, w, least(13, len(w)) as n, unnest(range(1, greatest(len(w) - 11, 2))) as i from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as s from bi),
sizes as (select distinct n from win),
di as (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as i from d, sizes),
dwin as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as s from di),
occ as (select dwin.doc_id, dwin.i, dwin.n, win.item_id from dwin join win using (n, s)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as told from (select distinct doc_id, cast(item_id as varchar) as k from occ) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(told, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

OP5_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as f from p where n >= 100 group by h)
select page_id, cast(n as bigint) as payload_bytes, p.h as payload_digest,
  case when f is not null and f <> page_id then 'revisit' else 'response' end as record_type,
  case when f <> page_id then f end as refers_to
from p left join f on p.h = f.h and p.n >= 100
"""


def queries() -> dict:
    own = (op1_toxicity, op2_decontamination, op3_media, op4_packing, op5_warc, op6_html, op7_chat, op8_jaccard, op9_suffix_tree, op10_quality, op11_tokens, op12_winnowing, op13_spelling)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op5_warc": OP5_SQL, "op7_chat": OP7_SQL}
