"""The queries of this subpackage: each applies one operator with its production parameters to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, langid, line_dedup, packing, quality_classifier, quality_rules, simhash, substring, toxicity
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_simhash_near_dedup,
        op3_packing,
        op4_language_id,
        op5_quality_classifier,
        op6_substring_dedup,
        op7_html_extraction,
        op8_decontamination,
        op9_line_dedup,
        op10_toxicity,
    )
}

_TELLING = """len(list_filter({t}, lambda x: x <> '' and x <> '<*>' and regexp_matches(x, '\\p{{L}}'))) >= 2 and (len(list_filter({t}, lambda x: x <> '' and x <> '<*>')) >= 7e-1 * len({t})
  or (2 * len(list_filter({t}, lambda x: x <> '' and x <> '<*>')) >= len(list_filter({t}, lambda x: x <> '<*>')) and len(list_filter({t}[4:], lambda x: x <> '' and x <> '<*>' and regexp_matches(x, '\\p{{L}}'))) >= 2))"""

#: Removal by windows and templates of lines can be told in plain SQL, the latter with each line held against each template of its
#: leaf; the other operators' methods cannot (XXH64, tokenizers, trained models, edit distance in place).
ORACLE_SQL = {
    "op9_line_dedup": f"""
with src as (select doc_id, coalesce(cast(doc_id as bigint), 9223372036854775807) as doc, text from documents
), l as (
  select doc, text, pos, line, array_to_string(list_filter(regexp_split_to_array(regexp_replace(line, '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '<*>', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), ' ') as norm
  from (select distinct doc, text, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line from src where text is not null)
), n as (
  select *, string_split(norm, ' ') as tokens, len(string_split(norm, ' ')) as n, greatest(len(string_split(norm, ' ')), strlen(norm) // 8) as weight,
    not contains(norm, '<*>') or len(list_filter(string_split(norm, ' '), lambda x: x <> '<*>' and regexp_matches(x, '\\p{{L}}'))) >= 2 as fixed from l where norm <> ''
), f as (
  select doc, text, pos, norm, tokens, case when fixed then norm else line end as same, case when fixed and n >= 4 then n || ' ' || array_to_string(tokens[1:3], ' ') end as leaf,
    case when weight > 50 then 2 when weight > 20 then 3 when weight >= 4 then 10 when regexp_matches(norm, '\\p{{L}}') then 100 end as need from n
), e as (
  select same, count(distinct text) as texts, min(doc) as least, min(need) as need, min(leaf) as leaf from f where need is not null group by same
), leaves as (
  select leaf from e where texts < need and leaf is not null group by leaf having sum(texts) >= 10
), m as (
  select f.doc, f.text, f.pos, f.leaf, f.norm, f.tokens from f join leaves using (leaf) where need is not null and same not in (select same from e where texts >= need)
), lines as (
  select leaf, norm, any_value(tokens) as tokens, count(distinct text) as texts from m group by leaf, norm
), places as (
  select leaf, norm, texts, unnest(range(len(tokens))) as place, unnest(tokens) as token from lines
), votes as (
  select *, case when n >= 10 then cast(floor(ln(n / 10 + 1e-9) / ln(4)) as int) else -1 end as level from (select leaf, place, token, sum(texts) as n from places group by all)
), most as (
  select leaf, list(token order by place) as template from (select leaf, place, case when 2 * max(n) >= sum(n) then max({{'n': n, 't': token}}).t else '' end as token from votes group by leaf, place) group by leaf
), fill as (
  select leaf, place, lv, min(token) as token from (select leaf, place, token, unnest([level, level - 1]) as lv from votes where level >= 0) where lv >= 0 group by leaf, place, lv having count(*) = 1
), levelled as (
  select p.leaf, p.norm, p.texts, p.place, p.token, v.level from places p join votes v using (leaf, place, token)
), starts as (
  select distinct leaf, norm, level as lo from levelled where level >= 0
), patterns as (
  select * from (select p.leaf, p.norm, any_value(p.texts) as texts, lo, list(case when p.level >= lo then p.token else '' end order by p.place) as template,
    list(case when p.level >= lo then p.token else coalesce(fill.token, '') end order by p.place) as filled
    from levelled p join starts using (leaf, norm) left join fill on fill.leaf = p.leaf and fill.place = p.place and fill.lv = lo group by p.leaf, p.norm, lo) where {_TELLING.format(t="template")}
), templates as (
  select *, cast(greatest(0, least(ceil(7e-1 * len(template) - 1e-9) - head, case when len(tail) >= 2 then ceil(7e-1 * len(tail) - 1e-9) end)) as int) as needed from (
    select leaf, template, len(list_filter(template[1:3], lambda x: x <> '' and x <> '<*>')) as head, list_filter(range(4, len(template) + 1), lambda i: template[i] <> '' and template[i] <> '<*>') as tail
    from (select leaf, template from most where {_TELLING.format(t="template")} union select leaf, filled from patterns group by leaf, filled having sum(texts) >= 10))
), matched as (
  select distinct m.doc, m.text, m.pos, 1 as kind, m.leaf, p.template from m join patterns p using (leaf, norm)
  union all select m.doc, m.text, m.pos, 2, m.leaf, t.template from m join templates t using (leaf) where needed <= len(tail) and len(list_filter(tail, lambda i: t.template[i] = m.tokens[i])) >= needed
), general as (
  select kind, leaf, template, min(doc) as least from matched group by all having count(distinct text) >= 10
), gone as (
  select doc, text, list(distinct pos) as gone from (
    select f.doc, f.text, f.pos from f join e on f.same = e.same where f.need is not null and e.texts >= e.need and f.doc > e.least
    union all select doc, text, pos from matched join general using (kind, leaf, template) where doc > least) group by doc, text
)
select doc_id, case when gone is null then text else array_to_string(list_transform(list_filter(range(len(string_split(text, chr(10)))), lambda i: not list_contains(gone, i)), lambda i: string_split(text, chr(10))[i + 1]), chr(10)) end as text,
  cast(coalesce(len(string_split(text, chr(10))), 0) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_dropped
from src left join gone using (doc, text)
""",
    "op6_substring_dedup": """
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents
), win as (
  select doc_id, i, array_to_string(words[i : i + 12], ' ') as k from w, unnest(range(1, len(words) - 11)) t(i) where len(words) >= 13
), hit as (
  select win.doc_id, win.i from win join (select k, min(doc_id) as least from win group by k having count(distinct doc_id) > 1) f using (k)
  where f.least < win.doc_id
), gone as (
  select distinct doc_id, i + d as spot from hit, unnest(range(0, 13)) u(d)
), gone_list as (
  select doc_id, list(spot) as spots from gone group by doc_id
)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(spots), 0) as bigint) as n_removed,
  sha256(array_to_string(case when spots is null then words else
    list_transform(list_filter(range(1, len(words) + 1), lambda p: not list_contains(spots, p)), lambda p: words[p]) end, ' ')) as kept_sha256
from w left join gone_list using (doc_id)
""",
}
