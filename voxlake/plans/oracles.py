"""SQL (DuckDB) that gives each registered query's rows, written apart from the Spark code."""

from __future__ import annotations

from voxlake.functions import unicode as U
from voxlake.functions.text import symbol_class

from .inputs import ARABIC, LATIN, REPO, REVISION, SPLIT


def _arabic(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{ARABIC}')"


def _raw(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{U.SPACE}]+', ' ', 'g'))"


def _norm(x: str) -> str:
    keep = U.arabic_letters() + U.decimal_digits() + "A-Za-z"
    return f"lower(trim(regexp_replace(regexp_replace({x}, '[{U.MARKS}]', '', 'g'), '[^{keep}]+', ' ', 'g')))"


def _tokens(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda t: t <> '')"


def _kind(t: str) -> str:
    ar, en = f"regexp_matches({t}, '[{U.arabic_letters()}]')", f"regexp_matches({t}, '[A-Za-z]')"
    return f"(case when {ar} and {en} then 'MIXED' when {ar} then 'AR_ONLY' when {en} then 'EN_ONLY' else 'OTHER' end)"


def _count(x: str, inside: str) -> str:
    return f"length(regexp_replace({x}, '[^{inside}]', '', 'g'))"


T = f"""t as (select doc_id, doc_id as index, doc_id::varchar as sample_id, case when doc_id % 4 = 1 then {_arabic('text')}
 when doc_id % 4 = 2 then array_to_string(list_transform(string_split(text, ' '), lambda w, i: case when (i - 1) % 3 = 0 then {_arabic('w')} else w end), ' ')
 else text end as transcript from documents)"""


def _with_stats(source: str, text: str, keys: str) -> str:
    """s: keys, n (normalised), token counts and category of a source."""
    return f"""n0 as (select {keys}, {_norm(text)} as n from {source}),
 n1 as (select *, {_tokens('n')} as ts from n0),
 n2 as (select *, list_transform(ts, lambda x: {_kind('x')}) as ks from n1),
 s as (select *, len(ts)::bigint as token_count, len(list_filter(ks, lambda x: x = 'AR_ONLY'))::bigint as ar_only, len(list_filter(ks, lambda x: x = 'EN_ONLY'))::bigint as en_only,
  len(list_filter(ks, lambda x: x = 'MIXED'))::bigint as mixed, len(list_filter(ks, lambda x: x = 'OTHER'))::bigint as other,
  len(list_filter(ts, lambda x: {_kind('x')} = 'EN_ONLY' and length(x) > 1))::bigint as en_only_meaningful from n2),
 c as (select *, case when ar_only > 0 and en_only_meaningful > 0 then 'AR_EN_CODE_SWITCHED' when ar_only > 0 then 'AR_ONLY' when en_only > 0 then 'EN_ONLY' else 'OTHER' end as category from s)"""


UTT = """u as (select (conv_id * 100 + turn)::varchar as sample_id, conv_id * 100 + turn as index, text as transcript,
 length(text) / (case when (conv_id * 100 + turn) % 9 = 0 then 40.0::double else 15.0::double end) as duration from conversations)"""
MISMATCH = "(length(c0) > 0 and duration > 0 and (length(c0) / duration < 0.5 or length(c0) / duration > 30.0))"
RECORDS = f"""{T}, {_with_stats('t', 'transcript', 'sample_id, index, transcript')},
 r as (select sample_id, index, case when n <> '' then sha256(n) end as transcript_sha256,
  case when length(transcript) % 7 = 0 then sha256(substring(transcript, 1, 20)) end as audio_sha256, category as language_category from c)"""
PRED = f"""p0 as (select conv_id * 100 + turn as key, length(text) as n, {_tokens(_norm('text'))} as w from conversations),
 p1 as (select *, list_transform(w, lambda x, i: case when key % 3 = 1 and (i - 1) % 3 = 0 then {_arabic('x')} else x end) as ref from p0),
 p2 as (select *, list_filter(ref, lambda x, i: (i - 1 + key) % 5 <> 0) as kept from p1),
 p3 as (select *, list_concat(list_transform(kept, lambda x, i: case when (i - 1 + key) % 7 = 0 then 'sub7' else x end),
  case when key % 11 = 0 and len(ref) > 0 then [ref[1], ref[1], ref[1]] else [] end) as hyp from p2),
 p as (select key::varchar as sample_id, key as index, ref, hyp, array_to_string(ref, ' ') as rt, array_to_string(hyp, ' ') as ht, n / 15.0::double as audio_seconds, n / 50.0::double as processing_seconds,
  key % 13 = 0 as silent from p3)"""
# Costs of a substitution, a deletion and an insertion in one number that orders (cost, i, d, s).
BITS = 15
SUB, DEL, INS = 1 + (1 << 3 * BITS), (1 << BITS) + (1 << 3 * BITS), (1 << 2 * BITS) + (1 << 3 * BITS)


def _aligned(source: str, ref: str, hyp: str, name: str = "a", carry: str = "") -> str:
    """name: sample_id, s, d, i, n of every row of a source (needs WITH RECURSIVE)."""
    extra = f", {carry}" if carry else ""
    return f"""{name}_in as (select sample_id{extra}, {ref} as r, {hyp} as h from {source}),
 {name}_dp as (select sample_id{extra}, r, h, 0 as k, list_transform(range(0, len(h) + 1), lambda j: j * {INS}::bigint) as row from {name}_in
  union all select sample_id{extra}, r, h, k + 1, list_reduce(list_transform(range(1, len(h) + 1), lambda j: [j::bigint]),
   lambda acc, x: list_append(acc, case when r[k + 1] = h[x[1]] then row[x[1]] else least(acc[x[1]] + {INS}::bigint, row[x[1] + 1] + {DEL}::bigint, row[x[1]] + {SUB}::bigint) end), [(k + 1) * {DEL}::bigint])
  from {name}_dp where k < len(r)),
 {name} as (select sample_id{extra}, row[-1] & {(1 << BITS) - 1} as s, (row[-1] >> {BITS}) & {(1 << BITS) - 1} as d, (row[-1] >> {2 * BITS}) & {(1 << BITS) - 1} as i, len(r)::bigint as n from {name}_dp where k = len(r))"""


def _rate(s="s", d="d", i="i", n="n") -> str:
    return f"(case when {n} = 0 and {i} = 0 then null when {n} = 0 then 1.0::double else ({s} + {d} + {i}) / {n}::double end)"


def _merged(name: str, prefix: str = "") -> str:
    return f"select sum(s)::bigint as {prefix}s, sum(d)::bigint as {prefix}d, sum(i)::bigint as {prefix}i, sum(n)::bigint as {prefix}n, {_rate('sum(s)', 'sum(d)', 'sum(i)', 'sum(n)')} as {prefix}rate from {name}"


def _english(x: str) -> str:
    return f"list_filter({x}, lambda t: {_kind('t')} = 'EN_ONLY')"


def _numbers(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[{U.letters_and_numbers()}]+(?:[.,\\x{{66B}}\\x{{66C}}/-][{U.letters_and_numbers()}]+)*'), lambda t: regexp_matches(t, '[0-9]'))"


def _common(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda x: x = t)), len(list_filter({b}, lambda x: x = t))))), 0)"


def _recall(a: str, b: str) -> str:
    return f"select sum({_common('a', 'b')})::bigint as matched, sum(len(a))::bigint as reference, case when sum(len(a)) > 0 then sum({_common('a', 'b')}) / sum(len(a))::double end as value from (select {a} as a, {b} as b from p)"


REPEATS = "(" + " or ".join(
    f"coalesce(list_bool_or(list_transform(range(1, len(hyp) - {3 * w} + 2), lambda i: hyp[i:i + {w - 1}] = hyp[i + {w}:i + {2 * w - 1}] and hyp[i + {w}:i + {2 * w - 1}] = hyp[i + {2 * w}:i + {3 * w - 1}])), false)"
    for w in range(1, 5)
) + ")"
SURPLUS = f"coalesce(list_bool_or(list_transform(list_distinct({_english('hyp')}), lambda t: len(list_filter(hyp, lambda x: x = t)) > len(list_filter(ref, lambda x: x = t)))), false)"
REASONS = f"""q as (select sample_id, audio_seconds, processing_seconds, list_filter([case when silent and ht <> '' then 'silent_speech' end, case when {REPEATS} then 'repeated_phrase' end,
 case when {SURPLUS} then 'invented_english' end,
 case when (len(hyp) >= 10 and length(ht) > greatest(20, 3 * length(rt))) or (audio_seconds < 1.0 and len(hyp) >= 10) then 'excessive_output' end], lambda x: x is not null) as reasons from p)"""
CATEGORY = f"""pc as (select sample_id, case when len(list_filter(ref, lambda x: {_kind('x')} = 'AR_ONLY')) > 0 and len(list_filter(ref, lambda x: {_kind('x')} = 'EN_ONLY' and length(x) > 1)) > 0
 then 'AR_EN_CODE_SWITCHED' when len(list_filter(ref, lambda x: {_kind('x')} = 'AR_ONLY')) > 0 then 'AR_ONLY' when len(list_filter(ref, lambda x: {_kind('x')} = 'EN_ONLY')) > 0 then 'EN_ONLY' else 'OTHER' end as category from p)"""
REPEATS_ONE = "coalesce(list_bool_or(list_transform(range(1, len(hyp) - 1), lambda i: hyp[i] = hyp[i + 1] and hyp[i + 1] = hyp[i + 2])), false)"
LABELS = f"""l0 as (select p.sample_id, {_rate('a.s', 'a.d', 'a.i', 'a.n')} as normalized_wer, list_filter([
 case when len({_english('ref')}) > 0 and {_common(_english('ref'), _english('hyp'))} < len({_english('ref')}) then 'english_term_error' end,
 case when len({_numbers('rt')}) > 0 and {_common(_numbers('rt'), _numbers('ht'))} < len({_numbers('rt')}) then 'number_error' end,
 case when (rt = '' and ht <> '') or length(ht) > greatest(20, 3 * length(rt)) then 'hallucination_candidate' end,
 case when {REPEATS_ONE} then 'repetition' end, case when audio_seconds < 1.0 then 'short_utterance_failure' end, case when audio_seconds > 15.0 then 'long_utterance_failure' end], lambda x: x is not null) as ls
 from p join a using (sample_id)),
 l as (select sample_id, normalized_wer, case when len(ls) > 0 then ls else ['other_word_error'] end as labels from l0 where normalized_wer > 0)"""
WAVES = """w as (select vec_id, case vec_id % 5 when 0 then list_transform(embedding::double[], lambda v: v * 0) when 2 then list_transform(embedding::double[], lambda v: least(greatest(v * 20, -1.0::double), 1.0::double))
 when 3 then list_transform(embedding::double[], lambda v, i: case when i = 1 then 'nan'::double else v end) else embedding::double[] end as x from embeddings)"""
BIGRAMS = f"""d0 as materialized (select doc_id as index, doc_id::varchar as sample_id, {_norm('text')} as n from documents), d1 as (select n, arg_min(sample_id, index) as sample_id from d0 where length(n) >= 10 group by n),
 b as materialized (select sample_id, list_distinct(list_concat(regexp_extract_all(n, '..'), regexp_extract_all(substring(n, 2), '..'))) as bs from d1), m as (select sample_id, unnest(bs) as bg from b),
 z as (select bg, count(*) as c from m group by bg), k as (select m.* from m join z using (bg) where c <= 64),
 pr as (select distinct x.sample_id as id_a, y.sample_id as id_b from k x join k y on x.bg = y.bg and x.sample_id < y.sample_id),
 it as (select id_a, id_b, count(*) as i from pr join m x on x.sample_id = id_a join m y on y.sample_id = id_b and x.bg = y.bg group by 1, 2),
 sim as (select id_a, id_b, i / (len(x.bs) + len(y.bs) - i)::double as similarity from it join b x on x.sample_id = id_a join b y on y.sample_id = id_b)"""
TARGETS = """cnt as (select language_category as c, count(*) as n from r group by 1), ratios(split, ratio, o) as (values ('train', 90, 0), ('validation', 5, 1), ('test', 5, 2)),
 ex as (select c, split, o, n, n * ratio // 100 as base, n * ratio % 100 as rem from cnt, ratios),
 tg as (select c as language_category, split, o, (base + (case when row_number() over (partition by c order by rem desc, o) <= n - sum(base) over (partition by c) then 1 else 0 end))::bigint as target from ex)"""
CANONICAL = """g as (select transcript_sha256, coalesce(transcript_sha256, sample_id) as k, sample_id, index, language_category from r),
 f as (select k, arg_min(struct_pack(s := sample_id, i := index, t := transcript_sha256, l := language_category), index) as b, count(*)::bigint as group_size,
  sha256(array_to_string(list_sort(list(sample_id)), chr(10))) as dedupe_group_sha256 from g group by k)"""
COMPONENTS = """e as (select sample_id as a, min(sample_id) over (partition by transcript_sha256) as b from r where transcript_sha256 is not null
  union select sample_id, min(sample_id) over (partition by audio_sha256) from r where audio_sha256 is not null),
 e2 as (select a, b from e where a <> b union select b, a from e where a <> b),
 cc as (select sample_id as node, sample_id as label from r union select e2.a, cc.label from cc join e2 on cc.node = e2.b),
 lab as (select node as sample_id, min(label) as grp from cc group by 1), g as (select r.*, grp from r join lab using (sample_id))"""
FOLD = """u0 as (select b.s as sample_id, b.l as cat, row_number() over (order by sha256('42:' || b.s), b.s) as k from f),
 cats as (select c, row_number() over (order by c) as ci from (select distinct cat as c from u0)),
 u as (select sample_id, k, ci from u0 join cats on cat = c),
 ct as (select cat as c, count(*) as n from u0 group by 1 union all select null, count(*) from u0),
 ratios(split, ratio, o) as (values ('train', 90, 0), ('validation', 5, 1), ('test', 5, 2)),
 ex as (select c, o, n, n * ratio // 100 as base, n * ratio % 100 as rem from ct, ratios),
 tg as (select c, o, (base + (case when row_number() over (partition by c order by rem desc, o) <= n - sum(base) over (partition by c) then 1 else 0 end))::bigint as target from ex),
 init as (select list(target order by ci, o) as lack from tg join cats using (c)), tot as (select list(target order by o) as whole from tg where c is null),
 st as (select 0::bigint as k, lack, whole, -1 as dest, ''::varchar as sample_id from init, tot
  union all select nk, list_transform(lack, lambda x, i: case when i = (ci - 1) * 3 + best then x - 1 else x end), list_transform(whole, lambda x, i: case when i = best then x - 1 else x end), best, sid
  from (select u.k as nk, ci, u.sample_id as sid, lack, whole, list_sort([struct_pack(a := -lack[(ci - 1) * 3 + 1], b := -whole[1], o := 1), struct_pack(a := -lack[(ci - 1) * 3 + 2], b := -whole[2], o := 2),
   struct_pack(a := -lack[(ci - 1) * 3 + 3], b := -whole[3], o := 3)])[1].o as best from st join u on u.k = st.k + 1)),
 asg as (select sample_id, ['train', 'validation', 'test'][dest] as split from st where k > 0)"""


def build() -> dict[str, str]:
    norm_t, raw_t = _norm("transcript"), _raw("transcript")
    stats = "token_count, ar_only, en_only, mixed, other, en_only_meaningful"
    sha = lambda i: f"sha256('{REPO}|{REVISION}|{SPLIT}|' || {i}::varchar)"
    utt_stats = f"{UTT}, {_with_stats('(select *, ' + raw_t + ' as c0 from u)', 'c0', 'sample_id, index, duration, c0')}"
    facts = f"""{utt_stats}, facts as (select *, ar_only > 0 and en_only_meaningful > 0 as code_switched, token_count > 50 or length(c0) > 300 as unusual_long, {MISMATCH} as mismatch, c0 = '' as empty_transcript from c)"""
    wer = f"with recursive {PRED}, {_aligned('p', 'ref', 'hyp')}"
    bucket_rate = _rate("sum(s)", "sum(d)", "sum(i)", "sum(n)")
    out = {
        "normalize_raw": f"with {T} select doc_id, {raw_t} as out from t",
        "audit_normalize": f"with {T} select doc_id, {norm_t} as out from t",
        "clean_transcript": f"with {T} select doc_id, {raw_t} as out from t",
        "character_counts": f"""with {T} select doc_id, {_count('transcript', U.arabic_letters())}::bigint as arabic, {_count('transcript', 'A-Za-z')}::bigint as english, {_count('transcript', U.decimal_digits())}::bigint as digits,
          length(regexp_replace(transcript, '[{U.SPACE}{U.decimal_digits()}{U.arabic_letters()}A-Za-z]', '', 'g'))::bigint as symbols from t""",
        "token_stats": f"with {T}, {_with_stats('t', 'transcript', 'doc_id')} select doc_id, {stats} from c",
        "language_categories": f"with {T}, {_with_stats('t', 'transcript', 'doc_id')} select category, count(*) as n from c group by 1",
        "letter_ratio": f"""with {T}, x as (select sum({_count('transcript', U.arabic_letters())})::bigint as a, sum({_count('transcript', 'A-Za-z')})::bigint as l from t)
          select a as arabic_letters, l as latin_letters, case when a + l = 0 then 0.0::double else a / (a + l)::double end as arabic_letter_ratio, case when a + l = 0 then 0.0::double else l / (a + l)::double end as latin_letter_ratio from x""",
        "unusually_long": f"with {T}, x as (select doc_id, {raw_t} as c, {norm_t} as n from t) select doc_id, len({_tokens('n')}) > 50 or length(c) > 300 as unusual_long, c = '' as empty_transcript from x",
        "duration_mismatch": f"with {UTT}, x as (select *, {raw_t} as c0 from u) select sample_id, case when duration <= 0 then 0.0::double else length(c0) / duration end as cps, {MISMATCH} as mismatch from x",
        "number_buckets": f"""with x as (select unnest(regexp_extract_all(text, '[{U.decimal_digits()}]+(?:[.,][{U.decimal_digits()}]+)?')) as t from documents)
          select case when regexp_matches(t, '[.,]') then 'decimal' when length(t) <= 1 then 'integer_digits_1' when length(t) <= 3 then 'integer_digits_2_3' else 'integer_digits_4_plus' end as bucket, count(*) as n from x group by 1""",
        "symbol_frequency": f"with x as (select unnest(regexp_extract_all(text, '{symbol_class()}')) as symbol from documents) select symbol, count(*) as n from x group by 1 order by n desc, symbol limit 50",
        "duration_quantiles": f"""with {UTT} select count(*) as n, sum(duration) as total_seconds, min(duration) as min_seconds, quantile_cont(duration, 0.25) as p25, quantile_cont(duration, 0.5) as median,
          quantile_cont(duration, 0.75) as p75, quantile_cont(duration, 0.95) as p95, max(duration) as max_seconds from u where duration >= 0""",
        "stable_sample_id": f"select doc_id, {sha('doc_id')} as sample_id from documents",
        "load_primary": f"select {sha('doc_id')} as sample_id, '{REPO}' as repo_id, '{REVISION}' as revision, '{SPLIT}' as split, doc_id as index, text as transcript, false as is_pseudo_labelled from documents",
        "load_pseudo_labelled": f"select {sha('doc_id')} as sample_id, doc_id as index, text as transcript, true as is_pseudo_labelled, false as audio_allowed from documents",
        "load_external": f"with {UTT} select sha256('{REPO}|{REVISION}|validation|' || index::varchar) as sample_id, index, transcript, duration, 'external_eval_only' as role from u",
        "transcript_fingerprint": f"with {T}, x as (select doc_id, {norm_t} as n from t) select doc_id, case when n <> '' then sha256(n) end as sha from x",
        "canonical_numbers": f"select doc_id, array_to_string({_numbers('text')}, ' ') as numbers from documents",
        "audit_facts": f"""with {facts} select sample_id, index, duration as duration_seconds, category as language_category, n as normalized, length(c0)::bigint as char_count, token_count, ar_only as ar_only_tokens,
          en_only as en_only_tokens, mixed as mixed_tokens, other as other_tokens, en_only_meaningful as en_meaningful_tokens, code_switched, unusual_long, mismatch, empty_transcript from facts""",
        "audit_summary": f"""with {facts} select count(*) as examples, count(*) as audio_examples, count(*) filter (empty_transcript) as empty_transcript, 0::bigint as silent, 0::bigint as clipped, 0::bigint as corrupted,
          count(*) filter (mismatch) as mismatch, count(*) filter (unusual_long) as unusual_long, count(*) filter (category = 'AR_EN_CODE_SWITCHED') as n_ar_en_code_switched, count(*) filter (category = 'AR_ONLY') as n_ar_only,
          count(*) filter (category = 'EN_ONLY') as n_en_only, count(*) filter (category = 'OTHER') as n_other, sum({_count('c0', U.arabic_letters())})::bigint as arabic_letters, sum({_count('c0', 'A-Za-z')})::bigint as latin_letters,
          sum(token_count)::bigint as tokens, count(*) filter (duration >= 0) as durations, min(duration) as min_seconds, quantile_cont(duration, 0.5) as median_seconds, max(duration) as max_seconds from facts""",
        "exact_duplicate_groups": f"with {RECORDS}, x as (select count(*) as n from r where transcript_sha256 is not null group by transcript_sha256) select count(*) filter (n > 1) as duplicate_groups, sum(n - 1)::bigint as extra_rows from x",
        "dedup_canonical": f"with {RECORDS}, {CANONICAL} select b.s as sample_id, b.i as index, b.t as transcript_sha256, group_size, dedupe_group_sha256 from f",
        "dedup_components": f"""with recursive {RECORDS}, {COMPONENTS} select arg_min(sample_id, index) as sample_id, min(index) as index, count(*)::bigint as group_size,
          sha256(array_to_string(list_sort(list(sample_id)), chr(10))) as dedupe_group_sha256 from g group by grp""",
        "dedup_counters": f"""with recursive {RECORDS}, {COMPONENTS}, x as (select count(*) as n from g group by grp), y as (select sum(n)::bigint as input_rows, sum(n - 1)::bigint as removed_rows, count(*) filter (n > 1) as duplicate_groups from x)
          select y.*, (select count(*) from (select 1 from r where transcript_sha256 is not null group by transcript_sha256 having count(*) > 1)) as transcript_collisions,
          (select count(*) from (select 1 from r where audio_sha256 is not null group by audio_sha256 having count(*) > 1)) as audio_collisions from y""",
        "near_duplicate_pairs": f"with {BIGRAMS} select * from sim where similarity >= 0.9 order by similarity desc, id_a, id_b limit 20",
        "near_duplicate_summary": f"""with {BIGRAMS}, x as (select count(*) as n from d0 where n <> '' group by n) select (select count(*) filter (n > 1) from x) as exact_groups, (select sum(n - 1)::bigint from x) as exact_extras,
          (select count(*) from d1) as unique_texts_indexed, (select count(*) filter (c > 64) from z) as oversized_buckets, (select count(*) from pr) as comparisons,
          (select least(20, count(*)) from sim where similarity >= 0.9) as near_duplicate_pair_count, (select count(*) from pr) > 2000000 as budget_exhausted""",
        "split_apportion": f"with {RECORDS}, {TARGETS} select language_category, split, target from tg",
        "split_assign": f"with recursive {RECORDS}, {CANONICAL}, {FOLD} select sample_id, split from asg",
        "split_metadata": f"with recursive {RECORDS}, {CANONICAL}, {FOLD} select split, cat as language_category, count(*) as n from asg join u0 using (sample_id) group by 1, 2",
        "leakage_check": f"""with {RECORDS}, x as (select *, case when index % 10 < 8 then 'train' when index % 10 = 8 then 'validation' else 'test' end as split from r),
          ks as (select transcript_sha256 as v, split, 't' as k from x where transcript_sha256 is not null union all select audio_sha256, split, 'a' from x where audio_sha256 is not null),
          kg as (select k, v, min(split) as a, max(split) as b from ks group by 1, 2), pr as (select x.split as a, y.split as b from x join x y on y.sample_id = (x.index + 3)::varchar where x.index % 50 = 0)
          select (select count(distinct sample_id) from x) as sample_ids, (select count(*) from kg) as exact_keys, (select count(*) from kg where a < b) as leaking_keys, (select count(*) from pr) as linked_pairs,
          (select count(*) from pr where a <> b) as crossing_pairs""",
        "wer_rows": f"{wer} select sample_id, s, d, i, n, {_rate()} as rate from a",
        "wer_summary": f"{wer}, m as ({_merged('a')}) select *, rate as raw_rate from m",
        "language_wer": f"""with recursive {PRED}, {_aligned('p', "list_filter(ref, lambda t: " + _kind('t') + " = 'AR_ONLY')", "list_filter(hyp, lambda t: " + _kind('t') + " = 'AR_ONLY')", 'ar')},
          {_aligned('p', _english('ref'), _english('hyp'), 'en')}, m as ({_merged('ar', 'arabic_')}), o as ({_merged('en', 'english_')}) select * from m, o""",
        "wer_buckets": f"{wer}, {CATEGORY} select category, count(*) as examples, sum(s)::bigint as s, sum(d)::bigint as d, sum(i)::bigint as i, sum(n)::bigint as n, {bucket_rate} as rate from a join pc using (sample_id) group by 1",
        "english_term_recall": f"with {PRED} {_recall(_english('ref'), _english('hyp'))}",
        "number_accuracy": f"with {PRED} {_recall(_numbers('rt'), _numbers('ht'))}",
        "benchmark_summary": f"""{wer}, {CATEGORY}, {REASONS} select (select count(*) from p) as examples, (select {bucket_rate} from a join pc using (sample_id) where category = 'AR_EN_CODE_SWITCHED') as code_switched_wer,
          (select count(*) filter (len(reasons) > 0) / count(*)::double from q) as hallucination_rate, (select count(*) filter (len(reasons) > 0) from q) as hallucination_flagged,
          (select round(sum(processing_seconds) / sum(audio_seconds), 9) from q) as rtf, (select count(*) from q) as rtf_timed_examples""",
        "training_metrics": f"{wer}, m as ({_merged('a')}), x as ({_recall(_english('ref'), _english('hyp'))}) select coalesce(m.rate, 'nan'::double) as wer, coalesce(x.value, 'nan'::double) as english_term_recall from m, x",
        "hallucination_reasons": f"with {PRED}, {REASONS}, x as (select unnest(reasons) as reason from q) select reason, count(*) as n from x group by 1",
        "telephone_delta": f"""{wer}, x as (select a.*, case when audio_seconds > 4 then 1 else 0 end as e from a join p using (sample_id)),
          y as (select count(*) as examples, {bucket_rate} as clean, {_rate('sum(s)', 'sum(d)', 'sum(i + e)', 'sum(n)')} as degraded from x) select *, degraded - clean as delta from y""",
        "error_categories": f"""{wer}, {LABELS}, x as (select unnest(labels) as label from l), every(label) as (values ('english_term_error'), ('number_error'), ('hallucination_candidate'), ('repetition'),
          ('short_utterance_failure'), ('long_utterance_failure'), ('other_word_error')) select every.label, count(x.label) as n from every left join x using (label) group by 1""",
        "error_review_sample": f"""{wer}, {LABELS}, x as (select sample_id, normalized_wer, unnest(labels) as label from l),
          y as (select label, row_number() over (partition by label order by sha256(label || ':' || sample_id), sample_id) as place, sample_id, normalized_wer from x) select * from y where place <= 5""",
        "audio_flags": f"""with {WAVES}, x1 as (select vec_id, x, list_bool_or(list_transform(x, lambda v: isnan(v) or isinf(v))) as bad from w)
          select vec_id, case when len(x) = 0 then true when bad then false else list_max(list_transform(x, lambda v: abs(v))) <= 0.0001 end as silent,
          case when len(x) = 0 or bad then false else len(list_filter(x, lambda v: abs(v) >= 0.999)) / len(x) >= 0.001 end as clipped, len(x) > 0 and bad as corrupted from x1""",
        "audio_duration": f"with {WAVES} select vec_id, len(x) / 16000.0::double as seconds from w",
        "resume_pending": f"with {PRED} select sample_id, index from p where index % 4 <> 0",
        "manifest_select": f"with {UTT}, x as (select * from u where index % 3 = 0) select index, transcript, 'm-' || sample_id as sample_id from x",
        "pilot_subset": f"with {UTT} select sample_id, index from u order by sha256('42:' || sample_id), sample_id limit 128",
        "pilot_hours": f"""with {UTT}, x as (select sample_id, length(transcript)::double as seconds, coalesce(sum(length(transcript)::double) over (order by index, u.sample_id rows between unbounded preceding and 1 preceding), 0) as b from u)
          select sample_id, seconds from x where b < 5000""",
        "wer_stop_rule": """with x as (select event_id as step, value as v, lag(value, 1) over (partition by user_id order by event_id) as a, lag(value, 2) over (partition by user_id order by event_id) as b from events)
          select step, coalesce(b < a and a < v, false) as rising, v is null or isnan(v) or isinf(v) as non_finite from x""",
    }
    return out
