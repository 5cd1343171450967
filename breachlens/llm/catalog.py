"""The operators of this folder bound to the test tables, and the SQL that must agree where SQL can say it."""

import public_tokenizers
from . import exact_dedup, language, mixing, near_dedup, packing, pieces, preference, quality_model, quality_rules, ranked, runs, token_counts, warc

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_preference_format(spark, folder):
    """Every conversation against itself with another conversation's answer, as masked pairs."""
    return preference.preference_pairs(preference.mismatched_answers(_table(spark, folder, "conversations")))


def op2_exact_dedup(spark, folder):
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents")).drop("n_bytes")


def op3_near_dedup(spark, folder):
    return near_dedup.near_duplicates(_table(spark, folder, "documents"), width=4)


def op4_mix_sources(spark, folder):
    return mixing.mix(_table(spark, folder, "documents")).drop("rate", "copies")


def op5_warc(spark, folder):
    return warc.archived(_table(spark, folder, "pages")).drop("payload")


def op6_quality_rules(spark, folder):
    return quality_rules.quality(_table(spark, folder, "documents")).drop("rejected_by")


def op7_quality_model(spark, folder):
    return quality_model.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_token_counts(spark, folder):
    return token_counts.token_counts(_table(spark, folder, "documents"), BYTE_VOCABULARY)


def op9_sentencepiece(spark, folder):
    return pieces.encoded(_table(spark, folder, "documents"), PIECE_MODEL, columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_language(spark, folder):
    return language.languages(_table(spark, folder, "documents"))


def op11_periodic_runs(spark, folder):
    return runs.digests(runs.periodic_runs(runs.extended(_table(spark, folder, "documents"))))


def op12_best_fit_packing(spark, folder):
    return packing.packed(_table(spark, folder, "documents"), WORD_VOCABULARY)


def op13_ranked_search(spark, folder):
    return ranked.rank(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_preference_format, op2_exact_dedup, op3_near_dedup, op4_mix_sources, op5_warc, op6_quality_rules, op7_quality_model,
        op8_token_counts, op9_sentencepiece, op10_language, op11_periodic_runs, op12_best_fit_packing, op13_ranked_search,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + ranked.TERM + "')"

ORACLES = {
    "op1_preference_format": """
with t as (select conv_id pair_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
last_answer as (select pair_id, max(turn) turn from t where role = 'assistant' group by pair_id),
answers as (select pair_id, turn, text from t join last_answer using (pair_id, turn) where role = 'assistant'),
sides as (
  select pair_id, 'chosen' side, turn, role, text from t
  union all
  select t.pair_id, 'rejected', t.turn, t.role, case when a.turn is not null then o.text else t.text end
  from t left join answers a on t.pair_id = a.pair_id and t.turn = a.turn and t.role = 'assistant' left join answers o on o.pair_id = t.pair_id + 1
  where a.turn is null or o.text is not null),
placed as (select *, row_number() over (partition by pair_id, side order by turn, role, text) as pos from sides),
matched as (
  select coalesce(c.pair_id, r.pair_id) pair_id, coalesce(c.pos, r.pos) as pos, c.role is not distinct from r.role and c.text is not distinct from r.text as same
  from (from placed where side = 'chosen') c full join (from placed where side = 'rejected') r on c.pair_id = r.pair_id and c.pos = r.pos),
common as (select pair_id, coalesce(min(pos) filter (not same) - 1, count(*)) n from matched group by pair_id),
spans as (
  select p.*, n, length(role) + 13 + coalesce(sum(length(role) + length(text) + 24) over (partition by pair_id, side order by pos rows between unbounded preceding and 1 preceding), 0) as b
  from placed p join common using (pair_id) where pos > n),
done as (
  select pair_id, side, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by pos) completion,
         coalesce(string_agg(b::bigint || '-' || (b + length(text) + 10)::bigint, ',' order by pos) filter (role = 'assistant'), '') mask,
         coalesce(sum(length(text) + 10) filter (role = 'assistant'), 0)::bigint learned
  from spans group by pair_id, side),
prompts as (
  select pair_id, n, count(*) filter (side = 'chosen') n_chosen, count(*) filter (side = 'rejected') n_rejected,
         coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by pos) filter (side = 'chosen' and pos <= n), '') prompt
  from placed join common using (pair_id) group by pair_id, n)
select p.pair_id, n::bigint n_common, n_chosen, n_rejected, prompt, coalesce(c.completion, '') chosen, coalesce(r.completion, '') rejected,
       coalesce(c.mask, '') chosen_mask, coalesce(r.mask, '') rejected_mask, coalesce(c.learned, 0) chosen_learned, coalesce(r.learned, 0) rejected_learned,
       case when n_chosen = 0 or n_rejected = 0 then 'one_sided' when c.completion is null and r.completion is null then 'identical' else 'pair' end status
from prompts p left join (from done where side = 'chosen') c on p.pair_id = c.pair_id left join (from done where side = 'rejected') r on p.pair_id = r.pair_id
""",
    "op2_exact_dedup": r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
select doc_id, min(doc_id) over w keep_id, count(*) over w group_size, doc_id = min(doc_id) over w kept, text_sha256
from d window w as (partition by text_sha256)
""",
    "op3_near_dedup": rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') w from documents),
s as (
  select distinct doc_id, array_to_string(case when len(w) < 4 then w else w[i:i + 3] end, ' ') shingle
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from words where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
pairs as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
edges as (select a x, b y from links union select b, a from links),
reach as (select doc_id node, doc_id root from n union select e.y, reach.root from reach join edges e on e.x = reach.node)
select d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(r.root, d.doc_id) component_id, d.doc_id = coalesce(r.root, d.doc_id) kept
from documents d left join n using (doc_id) left join (select node doc_id, min(root) root from reach group by node) r using (doc_id)
""",
    "op4_mix_sources": rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double weight from s),
o as (select *, source_size * 2.0::double as most, source_size * 2.0::double / weight as reach from w),
f as (
  select *, row_number() over x as pos,
    ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(most) over (x rows between unbounded preceding and 1 preceding), 0)) /
    (sum(weight) over () - coalesce(sum(weight) over (x rows between unbounded preceding and 1 preceding), 0)) as level
  from o window x as (order by reach, encode(source) nulls last)),
l as (select pos first_at, level first_level from f where level < reach order by pos limit 1),
t as (select source, source_size, case when pos >= first_at then weight * first_level else most end target from f left join l on true)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when place < rate - floor(rate) then 1 else 0 end))::bigint taken
from (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end::double rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0::double as place
  from d join t on d.source is not distinct from t.source)
""",
    "op5_warc": r"""
with p as (select page_id, coalesce(html, '') html from pages),
h as (select page_id, strlen(html)::bigint payload_bytes, sha1(html) hex from p),
b as (
  select page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - i % 4 * 5)) & 31) + 1)::int, 1)), 'string_agg', '') payload_digest
  from h)
select page_id, payload_bytes, payload_digest, case when page_id = response then 'response' else 'revisit' end record_type,
       case when page_id = response then null else response end refers_to
from (select *, max(page_id) over (partition by payload_digest) response from b)
""",
    "op6_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 4], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) > 4)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, s) > 1),
repeats as (select doc_id, count(distinct i + k) n from (select doc_id, i, unnest(range(5)) k from twice) group by doc_id),
lines as (
  select doc_id, sum(c - 1) n from (
    select doc_id, line, count(*) c from (select doc_id, unnest(string_split(text, chr(10))) line from d) where regexp_matches(line, '{_WORD}') group by all)
  group by doc_id),
c as (
  select doc_id, text, len(w)::bigint n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(lines.n, 0)::bigint n_dup_lines, coalesce(repeats.n, 0)::bigint n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) capital, length(regexp_replace(text, '[^a-z]', '', 'g')) small,
         strlen(regexp_replace(text, '[\x00-\x7F]', '', 'g')) others
  from d left join repeats using (doc_id) left join lines using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (
  base_failed or 2 * n_symbols > n_words or not (2 * n_words <= word_chars and word_chars <= 15 * n_words)
  or (n_dup_lines > 3 and 3 * n_dup_lines > length(regexp_replace(text, '[^\n]', '', 'g')) + 1)
  or (capital > 50 and capital > small)
  or 2 * (capital + small + others) < strlen(regexp_replace(text, '[ \n]', '', 'g'))
  or 2 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words) kept
from b
""",
    "op13_ranked_search": f"""
with t as (select doc_id, term, count(*) tf from (select doc_id, unnest({_TERMS}) term from documents) group by all),
d as (select doc_id, sum(tf)::bigint n from t group by doc_id),
s as (select count(*)::bigint docs, sum(n)::bigint words from d),
m as (select doc_id, 50 + (50 * n * docs) // words as m from d, s),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint w from t, s group by term, docs),
q as (select distinct item_id, unnest({_TERMS}) term from benchmark),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint score
  from q join w using (term) join t using (term) join m using (doc_id) group by item_id, doc_id)
select item_id, rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int rank from scored where score > 0) where rank <= 50
""",
}
