"""SQL for the queries SQL can express, over the same tables."""

ORACLES = {
    "p4_found": "select token from token_stream where token <> '' group by token order by count(*) desc, encode(token) limit 40",
    "p4_top_tokens": "select token, count(*) n from token_stream where token <> '' group by token order by n desc, encode(token) limit 40",
    "p6_term_frequencies": """
        with o as (select distinct token, line_id, tok_pos from token_stream where token is not null),
        s as (select token, count(*) occurrences, count(distinct line_id) n_lines from o group by 1),
        e as (select token, unnest(inverted_index) g from postings where token is not null),
        p as (select token, count(distinct g) n_rgs from e group by 1)
        select token, coalesce(occurrences, 0) occurrences, coalesce(n_lines, 0) n_lines, coalesce(n_rgs, 0) n_rgs from s full join p using (token)""",
    "p6_found": """
        with o as (select distinct token, line_id, tok_pos from token_stream where token is not null),
        s as (select token, count(*) occurrences from o group by 1),
        e as (select token, unnest(inverted_index) g from postings),
        t as (select count(distinct g) n from e),
        p as (select token, count(distinct g) n_rgs from e where token is not null group by 1),
        f as (select token, coalesce(occurrences, 0) occurrences, coalesce(n_rgs, 0) n_rgs from s full join p using (token))
        select token, case when n_rgs > 0.5 * (select n from t) then 'common' else 'rare' end mark
        from f where token <> '' and (n_rgs > 0.5 * (select n from t) or occurrences <= 2)""",
    "p8_found": """
        with w as (select item_id, regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+') ws from (select distinct item_id, question from eval_items)),
        g as (select distinct item_id, array_to_string(ws[i:i + 11], ' ') gram from (select item_id, ws, unnest(range(1, len(ws) - 10)) i from w)),
        d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') ws from documents where text is not null),
        h as (select doc_id, array_to_string(ws[i:i + 11], ' ') gram from (select doc_id, ws, unnest(range(1, len(ws) - 10)) i from d))
        select distinct doc_id, item_id from h join g using (gram)""",
    "p9_budgets": """
        select distinct mix_name, lower(trim(source)) as source, true meets_budget, true keeps_cap, true no_repeats from mix_targets where trim(source) <> ''""",
    "p10_word_ranks": """
        with w as (select doc_id, coalesce(lower(trim(lang)), '') lang, coalesce(len(regexp_extract_all(text, '\\S+')), 0) n_words from documents where doc_id is not null)
        select doc_id, lang, n_words, rank() over (partition by lang order by n_words) - 1 below,
          count(*) over (partition by lang order by n_words range between unbounded preceding and current row) upto, count(*) over (partition by lang) total from w""",
}
