"""DuckDB SQL of the queries, or of those columns of an operator that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES
from .url_templates import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORDS = r"[^\x20\x09-\x0D]+"
_RULES = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES.items())


def _places(phrase: str) -> str:
    words = phrase.split()
    same = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {same})"


_FOUND = ", ".join(f"{_places(p)} as p{k}" for k, p in enumerate(PHRASES))
_ALL = "list_concat(list_concat(p0, p1), p2)"
_LABELS = ", ".join(f"case when len(p{k}) > 0 then '{v}' end" for k, v in enumerate(PHRASES.values()))

def _linked(percent: int) -> str:
    """Documents ``t``, their set sizes ``n``, and the components ``c`` of those whose three-word shingles have that similarity."""
    return rf"""with recursive t as (select doc_id, regexp_extract_all({_TEXT}, '{_WORDS}') as w from documents), s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as x from t),
        n as (select doc_id, count(*) as n from s group by doc_id), p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all), l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {percent} * (x.n + y.n - k)),
        e as (select a, b from l union all select b, a from l), r as (select doc_id as node, doc_id as root from t union select e.b, r.root from r join e on r.node = e.a), c as (select node, min(root) as root from r group by node)"""


def _crc(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


#: crc32 of a string of which ``x`` is the hexadecimal UTF-8.
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))), lambda c, b: xor({[_crc(i) for i in range(256)]}[1 + (xor(c, b) & 255)], c >> 8)), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "url_rules": f"""with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages), h as (select page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as h from u),
        p as (select page_id, translate(h, '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') as path from h), r(rule, site, start, verdict) as (values {_RULES}),
        f as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from p join r on (host = site or ends_with(host, '.' || site)) and starts_with(path, start) group by page_id)
        select p.page_id, host, path, rule, f.verdict as rule_verdict from p left join f using (page_id)""",
    "license_base": rf"""with t as (select doc_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents), f as (select doc_id, len(w) as n, {_FOUND} from t)
        select doc_id, n as n_words, len({_ALL}) as n_base, list_min({_ALL}) - 1 as first_word, list_max({_ALL}) - 1 as last_word, array_to_string(list_sort(list_filter([{_LABELS}], lambda x: x is not null)), ',') as base_labels from f""",
    "shard_sizes": "select doc_id, cast(coalesce(strlen(text), 0) + 16 as bigint) as size, 'bytes' as law from documents",
    "mixing_targets": rf"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) as bigint) as size from documents), s as (select source, sum(size) as n, row_number() over (order by source nulls last) - 1 as k from d group by source),
        w as (select source, cast(n as double) as n, [1, 2, 3][1 + k % 3] as w, 3e0 * n as l from s), o as (select *, l / w as fill, sum(n) over () - coalesce(sum(l) over b, 0) as rest, sum(w) over () - coalesce(sum(w) over b, 0) as ws from w window b as (order by l / w, source nulls last rows between unbounded preceding and 1 preceding)),
        g as (select min(rest / ws) filter (rest / ws <= fill) as low, arg_min(rest / ws, fill) filter (rest / ws <= fill) as level from o), t as (select source, cast(n as bigint) as source_size, least(l, w * coalesce(level, fill)) as target from o, g)
        select doc_id, size, source_size, round(target, 4) as target from d join t on d.source is not distinct from t.source""",
    "op8_minhash_near_dedup": _linked(85) + " select t.doc_id, coalesce(n.n, 0) as n_shingles, root as component_id, t.doc_id = root as kept from t left join n using (doc_id) join c on node = t.doc_id",
    "op9_quality_rules": rf"""with t as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from documents), g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as x from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from t)),
        k as (select doc_id, count(distinct i + o) as n from (select doc_id, i from (select *, count(*) over (partition by doc_id, x) as c from g) where c > 1), range(5) r(o) group by doc_id),
        y as (select doc_id, source, unnest(string_split(text, chr(10))) as line from t), z as (select doc_id, source, line, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) as plain, len(regexp_extract_all(line, '{_WORDS}')) as n from y where regexp_matches(line, '[^\x20\x09-\x0D]')),
        u as (select doc_id, count(*) - count(distinct line) as dup from z group by doc_id), v as (select doc_id, any_value(source) as source, string_agg(plain, chr(10)) as whole from (select z.*, row_number() over () as r from z order by r) group by doc_id), v0 as (select t.doc_id, t.source, coalesce(whole, '') as whole from t left join v using (doc_id)),
        h as (select source, plain, count(distinct md5(whole)) as docs from (select distinct doc_id, source, plain from z) join v0 using (doc_id, source) group by all), o as (select source, count(distinct md5(whole)) as n from v0 group by source), c as (select h.source, plain from h join o using (source) where docs > 20 and docs > n * 0.01),
        q as (select doc_id, sum(n) as gone from z join c using (source, plain) group by doc_id), b as (select t.doc_id, len(w) as n, list_sum(list_transform(w, lambda x: length(x))) as chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as sym, coalesce(dup, 0) as dup, coalesce(k.n, 0) as rep, gone from t left join u using (doc_id) left join k using (doc_id) left join q using (doc_id)),
        f as (select *, n < 10 or 100 * rep > 20 * n as failed, greatest(0, n - coalesce(gone, 0)) as rest from b)
        select doc_id, n as n_words, cast(coalesce(chars, 0) as bigint) as word_chars, sym as n_symbols, dup as n_dup_lines, rep as n_repeat_words, failed as base_failed, not failed and not (gone is not null and (rest < 5 or rest < n * 0.2)) as kept, cast(rest as bigint) as n_left from f""",
    "op11_hard_negatives": """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256e0 * x)) as v from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as s from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
        p as (select a, b as positive_id, s as p from (select *, row_number() over (partition by a order by s desc, b) as r from s where same) where r <= 5),
        n as (select p.*, b, s, row_number() over (partition by p.a, positive_id order by s desc, b) as rank from p join s on p.a = s.a and not same and 30 * p <= 100 * s and 100 * s <= 90 * p)
        select a as anchor_id, positive_id, cast(rank as integer) as rank, b as negative_id, p as positive_score, s as negative_score from n where rank <= 10""",
    "op12_ngram_join": _linked(90) + " select t.doc_id, coalesce(n.n, 0) as n_shingles, root as component_id from t left join n using (doc_id) join c on node = t.doc_id",
    "op13_spelling_variants": rf"""with recursive r as (select coalesce(cast(doc_id as varchar), '') as d, unnest(regexp_extract_all({_TEXT}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents), g as (select d, run, count(*) as k from r where length(run) >= 7 group by all), x as (select *, hex(encode(d || ':' || run)) as x from g),
        h as (select *, {_CRC} as h from x), t as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) else run end as word, k from h), w as (select word, cast(sum(k) as bigint) as n from t where length(word) >= 7 group by word having sum(k) >= 2),
        d as (select word, i, substr(word, 1, i) || substr(word, i + 2) as cut from (select word, unnest(range(0, length(word))) as i from w)), p as (select a.word, b.word as near from d a join d b on a.i = b.i and a.cut = b.cut and a.word <> b.word union select d.word, w.word from d join w on cut = w.word union select w.word, d.word from d join w on cut = w.word),
        b as (select p.word, count(*) as n_near, max(w.n) as m, (list(near order by w.n desc, encode(near)))[1] as near from p join w on w.word = near group by p.word), f as (select w.word, case when m >= 10 * n then near end as form, n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then m end as form_n from w left join b on b.word = w.word),
        e as (select word, word as at from f where form is null union all select f.word, e.at from f join e on f.form = e.word)
        select f.word, form, e.at as root, n, n_near, form_n from f join e on e.word = f.word""",
}
