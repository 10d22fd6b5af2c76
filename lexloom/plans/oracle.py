"""DuckDB SQL for the registered queries, written from the definitions and independent of the DataFrame code."""

from __future__ import annotations

from ..operators.annotate import AUXILIARIES, CONJUNCTIONS, DETERMINERS, GROUP_NAMES, PREPOSITIONS, PRONOUNS, STOPWORDS, TAG_GROUPS

_QUOTED = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"

TAG = f"""CASE WHEN NOT regexp_matches(surface, '[\\p{{L}}\\p{{N}}]') THEN '.'
  WHEN regexp_full_match(surface, '[0-9]+') THEN 'CD' WHEN token = 'to' THEN 'TO'
  WHEN token IN {_QUOTED(DETERMINERS)} THEN 'DT' WHEN token IN {_QUOTED(PREPOSITIONS)} THEN 'IN'
  WHEN token IN {_QUOTED(CONJUNCTIONS)} THEN 'CC' WHEN token IN {_QUOTED(PRONOUNS)} THEN 'PRP'
  WHEN token IN {_QUOTED(AUXILIARIES)} THEN 'VBZ' WHEN ends_with(token, 'ed') THEN 'VBD'
  WHEN ends_with(token, 'ing') THEN 'VBG' WHEN ends_with(token, 'ly') THEN 'RB' WHEN ends_with(token, 'ble') THEN 'JJ'
  WHEN pos > 0 AND regexp_matches(surface, '^\\p{{Lu}}') THEN 'NNP' WHEN ends_with(token, 's') THEN 'NNS' ELSE 'NN' END"""

BASE = f"""lines AS (SELECT doc_id, unnest(ls) AS s, unnest(range(len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
s0 AS (SELECT doc_id, doc_id * 100000 + line AS sent_id, regexp_extract_all(s, '([\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s])', 1) AS ws FROM lines),
toks AS (SELECT sent_id, pos, surface, token, {TAG} AS tag, NOT regexp_matches(surface, '[\\p{{L}}\\p{{N}}]') AS is_punc
  FROM (SELECT sent_id, unnest(range(len(ws))) AS pos, unnest(ws) AS surface, unnest(list_transform(ws, lambda x: lower(x))) AS token FROM s0)),
sents AS (SELECT sent_id, list(token ORDER BY pos) AS tl, list(tag ORDER BY pos) AS gl FROM toks GROUP BY sent_id)"""


def grams(max_len: int, name: str = "grams", words: str = "tl") -> str:
    return f"""{name} AS (SELECT sent_id, n, st, array_to_string({words}[st + 1:st + n], ' ') AS gram, array_to_string(gl[st + 1:st + n], ' ') AS tags
  FROM (SELECT *, unnest(range(len({words}) - n + 1)) AS st FROM (SELECT *, unnest(range(1, least({max_len}, len({words})) + 1)) AS n FROM sents)))"""


def patterns(max_len: int, sup: int = 10) -> str:
    return f"{grams(max_len)}, patterns AS (SELECT gram, n, count(*) AS freq FROM grams GROUP BY gram, n HAVING count(*) >= {sup})"


def with_base(rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE}, {rest}"


IDF = "n_sents AS (SELECT count(*) AS k FROM sents), idf AS (SELECT token, count(DISTINCT sent_id) AS df, ln((SELECT k FROM n_sents) / count(DISTINCT sent_id) + 1e-8) AS idf FROM toks GROUP BY token)"
CASE_CODE = r"CASE WHEN (upper(surface) = surface AND regexp_matches(surface, '\p{L}')) OR NOT regexp_matches(surface, '[\p{L}\p{N}]') THEN 3 WHEN regexp_matches(surface, '^\p{Lu}') THEN 1 WHEN regexp_full_match(surface, '[0-9]+') THEN 4 ELSE 0 END"
FLAGS = f"""f0 AS (SELECT *, {CASE_CODE} AS code,
    CASE WHEN lead(is_punc) OVER w THEN lead(token) OVER w END AS nxt,
    last_value(CASE WHEN is_punc THEN token END IGNORE NULLS) OVER (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    last_value(CASE WHEN is_punc THEN token END IGNORE NULLS) OVER (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS here
  FROM toks WINDOW w AS (PARTITION BY sent_id ORDER BY pos)),
flagged AS (SELECT sent_id, pos, token,
    (NOT is_punc AND code IN (1, 3))::INT AS first_capital, (NOT is_punc AND code = 3)::INT AS all_capital,
    coalesce(nxt = '-', false)::INT AS dash_after,
    coalesce(NOT is_punc AND before IN ('"', '''''', '``'), false)::INT AS quote_before,
    coalesce(nxt IN ('"', '''''') OR (nxt IS NOT NULL AND here = '``'), false)::INT AS quote_after,
    coalesce(NOT is_punc AND before = '(', false)::INT AS paren_before, coalesce(nxt = ')', false)::INT AS paren_after,
    coalesce(nxt IN (',', '.', ':', ';', '!', '?', '-', '(', ')', '"', '''''', '``', '''', '/', '|'), false)::INT AS separator_after FROM f0)"""
PROB = "total AS (SELECT count(*) AS nt FROM toks), probable AS (SELECT *, CASE WHEN n > 1 THEN (freq + 1e-8) * n / nt ELSE freq::DOUBLE / nt END AS prob FROM patterns, total)"
OCC = "occ AS (SELECT gram, n, sent_id, st, st + n - 1 AS ed FROM grams SEMI JOIN patterns USING (gram))"
PARTS = "parts AS (SELECT gram, n, freq, array_to_string(w[1:n - 1], ' ') AS a, array_to_string(w[2:n], ' ') AS b FROM (SELECT *, string_split(gram, ' ') AS w FROM patterns WHERE n > 1))"
COMPLETE = f"""{PARTS},
sup AS (SELECT g AS gram, max(freq) AS sf FROM (SELECT a AS g, freq FROM parts UNION ALL SELECT b, freq FROM parts) GROUP BY g),
comp AS (SELECT p.gram, p.n, p.freq, CASE WHEN p.n > 1 THEN p.freq / greatest(p.freq, coalesce(x.freq, 0), coalesce(y.freq, 0)) END AS complete_sub, coalesce(sf, 0) / p.freq AS complete_super
  FROM patterns p LEFT JOIN parts q USING (gram) LEFT JOIN patterns x ON x.gram = q.a LEFT JOIN patterns y ON y.gram = q.b LEFT JOIN sup ON sup.gram = p.gram)"""
QUALITY = f"{COMPLETE}, scored AS (SELECT gram, n, freq, round(CASE WHEN n > 1 THEN complete_sub ELSE (freq % 100) / 100.0 END, 6) AS quality, ['BP', 'EP', 'RP'][(freq % 3)::INT + 1] AS indicator FROM comp)"
CHUNK = r"(NNP CD |(?:DT |PRP\$ )?(?:JJ )*(?:NN |NNS )+|(?:NNP )+IN (?:NNP )+|(?:NNP )+)"
#: Chunks by splitting the tag string: tags between matches and in them give the offsets.
CHUNKS = f"""c0 AS (SELECT sent_id, tl, array_to_string(gl, ' ') || ' ' AS said FROM sents),
c1 AS (SELECT sent_id, tl, string_split(regexp_replace(said, '{CHUNK}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM c0),
c2 AS (SELECT sent_id, tl, p, list_transform(p, lambda x: len(list_filter(string_split(replace(x, chr(2), ''), ' '), lambda t: t <> ''))) AS k FROM c1),
c3 AS (SELECT sent_id, tl, unnest(range(2, len(p) + 1)) AS i, p, k FROM c2),
chunks AS (SELECT sent_id, list_sum(k[1:i - 1])::BIGINT AS st, len(string_split(t, ' ')) AS n, t AS tags, tl FROM (SELECT *, rtrim(string_split(p[i], chr(2))[1]) AS t FROM c3)),
chunk AS (SELECT sent_id, st, n, array_to_string(tl[st + 1:st + n], ' ') AS text, tags FROM chunks)"""
RELATION = r"(((VB|VBD|VBG|VBN|VBP|VBZ) )+((NN.{0,2}|JJ.{0,1}|RB.{0,1}|PRP.{0,1}|DT ))+((IN|RP) +)|((VB|VBD|VBG|VBN|VBP|VBZ) )+((IN|RP) +)|((VB|VBD|VBG|VBN|VBP|VBZ) )+|(NN.{0,2})+((IN|RP) +))"
GROUP = "CASE " + " ".join(f"WHEN x IN {_QUOTED(t)} THEN '{g}'" for g, t in TAG_GROUPS.items()) + " ELSE 'NA' END"
_STOP = _QUOTED(STOPWORDS)
RATIOS = """occ_flags AS (SELECT o.gram, o.n, o.sent_id, o.st,
    max(CASE WHEN f.pos = o.st THEN quote_before ELSE 0 END) * max(CASE WHEN f.pos = o.ed THEN quote_after ELSE 0 END) AS q,
    max(CASE WHEN f.pos < o.ed THEN dash_after ELSE 0 END) AS d,
    max(CASE WHEN f.pos = o.st THEN paren_before ELSE 0 END) * max(CASE WHEN f.pos = o.ed THEN paren_after ELSE 0 END) AS p,
    min(first_capital) AS c, min(all_capital) AS a
  FROM occ o JOIN flagged f ON f.sent_id = o.sent_id AND f.pos BETWEEN o.st AND o.ed GROUP BY o.gram, o.n, o.sent_id, o.st),
ratios AS (SELECT gram, n, avg(q) AS quote, avg(d) AS dash, avg(p) AS parenthesis, avg(c) AS first_cap, avg(a) AS all_cap FROM occ_flags GROUP BY gram, n)"""
VITERBI = f"""{patterns(5)}, {QUALITY},
share AS (SELECT gram, freq::DOUBLE / sum(freq) OVER (PARTITION BY n) AS sh FROM patterns),
score AS (SELECT gram, ln(sh + 1e-8) + ln(quality + 1e-8) AS s FROM share JOIN scored USING (gram)),
e0 AS (SELECT sent_id, st, st + n AS ed, s FROM grams JOIN score USING (gram)),
edges AS (SELECT * FROM e0 UNION ALL SELECT sent_id, pos, pos + 1, 0.0 FROM toks ANTI JOIN e0 ON e0.sent_id = toks.sent_id AND e0.st = toks.pos),
ends AS MATERIALIZED (SELECT sent_id, ed, list({{'st': st, 's': s}} ORDER BY st) AS l FROM edges GROUP BY sent_id, ed),
v AS (SELECT sent_id, 0::BIGINT AS j, len(tl)::BIGINT AS n, [0.0::DOUBLE] AS f, [0::BIGINT] AS pre FROM sents
  UNION ALL SELECT sent_id, j + 1, n, list_append(f, list_max(c)), list_append(pre, l[list_position(c, list_max(c))].st)
  FROM (SELECT v.*, e.l, list_transform(e.l, lambda x: x.s + v.f[x.st + 1]) AS c FROM v JOIN ends e ON e.sent_id = v.sent_id AND e.ed = v.j + 1)),
final AS MATERIALIZED (SELECT sent_id, n, f[n + 1] AS score, pre FROM v WHERE j = n),
b AS (SELECT sent_id, pre, pre[n + 1] AS st, n AS ed FROM final UNION ALL SELECT sent_id, pre, pre[st + 1], st FROM b WHERE st > 0),
segs AS (SELECT sent_id, st, ed FROM b)"""

SQL: dict[str, str] = {
    "ngram_mining": with_base(f"{patterns(5)} SELECT gram, n, freq FROM patterns"),
    "tag_ngram_mining": with_base(f"{grams(5, words='gl')} SELECT gram, n, count(*) AS freq FROM grams GROUP BY gram, n HAVING count(*) >= 10"),
    "vocab_first_seen": with_base("f AS (SELECT token, min((sent_id, pos)) AS seen, bool_or(is_punc) AS is_punc FROM toks GROUP BY token) SELECT token, row_number() OVER (ORDER BY seen) AS token_id, is_punc FROM f"),
    "encode_sentences": with_base("f AS (SELECT token, min((sent_id, pos)) AS seen FROM toks GROUP BY token HAVING count(*) > 1), i AS (SELECT token, row_number() OVER (ORDER BY seen) AS id FROM f) SELECT sent_id, string_agg(coalesce(id, -1)::VARCHAR, ' ' ORDER BY pos) AS ids FROM toks LEFT JOIN i USING (token) GROUP BY sent_id"),
    "case_codes": with_base(f"t AS (SELECT surface, {CASE_CODE} AS code, count(*) AS n FROM toks GROUP BY surface) SELECT * FROM t"),
    "token_flags": with_base(f"{FLAGS} SELECT token, count(*) AS n, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("first_capital", "all_capital", "dash_after", "quote_before", "quote_after", "paren_before", "paren_after", "separator_after")) + " FROM flagged GROUP BY token"),
    "idf": with_base(f"{IDF} SELECT token, df, round(idf, 6) AS idf FROM idf"),
    "pos_prune_mining": with_base(f"""{grams(5)}, ok AS (SELECT gram, n FROM grams WHERE string_split(tags, ' ')[1] NOT IN ('DT', '.') AND len(list_filter(string_split(tags, ' ')[2:], lambda x: x IN ('.', 'CC', 'DT'))) = 0)
      SELECT gram, n, count(*) AS freq FROM ok GROUP BY gram, n HAVING count(*) >= 10"""),
    "first_tags": with_base(f"{patterns(5)} SELECT gram, arg_min(tags, (sent_id, st)) AS tags FROM grams SEMI JOIN patterns USING (gram) GROUP BY gram"),
    "occurrences": with_base(f"{patterns(5)}, {OCC} SELECT gram, sent_id, st, ed FROM occ WHERE n > 1"),
    "external_patterns": with_base(f"{patterns(5)}, {CHUNKS}, ext AS (SELECT DISTINCT text AS gram, len(string_split(text, ' ')) AS n FROM chunk WHERE n > 1 AND NOT contains(text, 'www') AND NOT contains(text, '.com')) SELECT gram, n, freq FROM patterns UNION ALL SELECT gram, n, 10 FROM ext ANTI JOIN patterns USING (gram) WHERE n <= 5"),
    "pmi_split": with_base(f"""{patterns(5)}, {PROB}, w AS (SELECT gram, freq, prob, string_split(gram, ' ') AS w, unnest(range(1, n)) AS i FROM probable WHERE n > 1),
      h AS (SELECT w.gram, w.freq, w.prob, i, l.prob * r.prob AS p, l.freq AS lf, r.freq AS rf FROM w JOIN probable l ON l.gram = array_to_string(w[1:i], ' ') JOIN probable r ON r.gram = array_to_string(w[i + 1:], ' ')),
      t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY gram ORDER BY p DESC, i) = 1)
      SELECT gram, round(prob / p, 4) AS f1, round(freq / sqrt(lf + 1e-8) / sqrt(rf + 1e-8), 6) AS f2, round(freq * ln(prob / p), 4) AS f4 FROM t"""),
    "context_outside": with_base(f"""{patterns(5)}, {OCC}, {IDF}, tf AS (SELECT sent_id, token, count(*) AS tf FROM toks GROUP BY ALL),
      pw AS (SELECT gram, token, count(*) AS k FROM (SELECT gram, unnest(string_split(gram, ' ')) AS token FROM patterns WHERE n > 1) GROUP BY ALL),
      c AS (SELECT o.gram, pw.token, pw.k, o.sent_id, o.st, coalesce(sum(tf.tf), 0) AS seen FROM occ o JOIN pw USING (gram) LEFT JOIN tf ON tf.token = pw.token AND tf.sent_id BETWEEN o.sent_id - 1 AND o.sent_id + 1 GROUP BY ALL),
      m AS (SELECT gram, token, k, avg(seen - k) AS extra FROM c GROUP BY ALL)
      SELECT gram, round(sum(k * idf * extra) / sum(k * idf), 5) AS outside FROM m JOIN idf USING (token) GROUP BY gram"""),
    "punct_ratios": with_base(f"{patterns(5)}, {OCC}, {FLAGS}, {RATIOS} SELECT gram, round(quote, 6) AS quote, round(dash, 6) AS dash, round(parenthesis, 6) AS parenthesis, round(first_cap, 6) AS first_cap FROM ratios WHERE n > 1"),
    "stopword_features": with_base(f"""{patterns(5)}, {IDF}, w AS (SELECT gram, n, unnest(string_split(gram, ' ')) AS token, unnest(range(n)) AS j FROM patterns),
      x AS (SELECT *, (token IN {_STOP})::INT AS stop, (token IN {_STOP} OR regexp_full_match(token, '[0-9]+'))::INT AS wide FROM w)
      SELECT gram, max(CASE WHEN j = 0 THEN wide ELSE 0 END) AS stop_first, max(CASE WHEN j = n - 1 THEN stop ELSE 0 END) AS stop_last, round(avg(wide), 6) AS stop_ratio, round(avg(coalesce(idf, 0)), 6) AS avg_idf FROM x LEFT JOIN idf USING (token) GROUP BY gram, n"""),
    "completeness": with_base(f"{patterns(5)}, {COMPLETE} SELECT gram, n, round(complete_sub, 6) AS complete_sub, round(complete_super, 6) AS complete_super FROM comp"),
    "pos_ratios": with_base(f"{patterns(5)}, t AS (SELECT gram, string_split(arg_min(tags, (sent_id, st)), ' ') AS g FROM grams SEMI JOIN patterns USING (gram) GROUP BY gram), u AS (SELECT gram, list_transform(g, lambda x: {GROUP}) AS g FROM t) SELECT gram, " + ", ".join(f"round(len(list_filter(g, lambda x: x = '{k}')) / len(g), 6) AS pos_{k.lower()}" for k in GROUP_NAMES) + " FROM u"),
    "tag_bigram_features": with_base(f"{patterns(5)}, t AS (SELECT gram, ' ' || arg_min(tags, (sent_id, st)) || ' ' AS g FROM grams SEMI JOIN patterns USING (gram) GROUP BY gram) SELECT gram, contains(g, ' DT NN ')::INT AS has_dt_nn, contains(g, ' NN IN ')::INT AS has_nn_in, contains(g, ' JJ NN ')::INT AS has_jj_nn FROM t"),
    "unigram_features": with_base(f"""{patterns(5)}, {OCC}, {IDF}, {FLAGS}, {RATIOS}, {COMPLETE}, tot AS (SELECT token AS gram, count(*) AS total FROM toks GROUP BY token)
      SELECT c.gram, round(ln(c.freq + 1.0), 6) AS log_freq, round(c.freq / total, 6) AS independent, (c.gram IN {_STOP} OR regexp_full_match(c.gram, '[0-9]+'))::INT AS stop, round(idf, 6) AS idf, round(quote, 6) AS quote, round(parenthesis, 6) AS parenthesis, round(first_cap, 6) AS first_cap, round(all_cap, 6) AS all_cap, round(complete_super, 6) AS complete_super
      FROM comp c JOIN tot USING (gram) JOIN idf ON idf.token = c.gram JOIN ratios r ON r.gram = c.gram WHERE c.n = 1"""),
    "distant_labels": with_base(f"{patterns(5)} SELECT gram, CASE WHEN freq % 3 = 0 THEN 1 WHEN freq % 2 = 0 THEN 2 ELSE 0 END AS label FROM patterns"),
    "label_cap": with_base(f"{patterns(5)} SELECT gram FROM patterns WHERE freq % 3 = 0 ORDER BY md5(gram), gram LIMIT 100"),
    "length_sample": with_base(f"{patterns(5)}, q AS (SELECT n, floor(500 * count(*) / (SELECT count(*) FROM patterns))::BIGINT AS quota FROM patterns GROUP BY n) SELECT gram, n FROM patterns JOIN q USING (n) QUALIFY row_number() OVER (PARTITION BY n ORDER BY md5(gram), gram) <= any_value(quota) OVER (PARTITION BY n)"),
    "length_share": with_base(f"{patterns(5)} SELECT gram, n, round(freq / sum(freq) OVER (PARTITION BY n), 9) AS share FROM patterns"),
    "length_penalty_score": with_base(f"{patterns(5)}, {QUALITY}, l AS (SELECT n, ln(pow(0.5, n) / sum(pow(0.5, n)) OVER ()) AS lp FROM (SELECT DISTINCT n FROM patterns)), s AS (SELECT gram, n, freq::DOUBLE / sum(freq) OVER (PARTITION BY n) AS sh FROM patterns) SELECT s.gram, round(ln(sh + 1e-8) + ln(quality + 1e-8) + lp, 5) AS score FROM s JOIN scored USING (gram) JOIN l ON l.n = s.n"),
    "quality_filter": with_base(f"""{patterns(5)}, {QUALITY} SELECT gram, (n = 1 OR freq > 0) AS eligible,
      ((n > 1 AND ((indicator = 'RP' AND quality >= 0.65) OR (indicator = 'EP' AND quality >= 0.5) OR (indicator = 'BP' AND quality < 0.6))) OR (n = 1 AND quality >= 0.5)) AS in_trie,
      ((n > 1 AND quality >= 0.65) OR (n = 1 AND quality >= 0.5)) AS in_output, (((n > 1 AND quality >= 0.65) OR (n = 1 AND quality >= 0.5)) AND indicator = 'RP') AS in_tuples FROM scored"""),
    "ranking_lists": with_base(f"{patterns(5)}, {QUALITY}, b AS (SELECT *, CASE WHEN n = 1 THEN 'unigram' WHEN indicator = 'EP' THEN 'E' WHEN indicator = 'RP' THEN 'R' ELSE 'B' END AS bucket FROM scored) SELECT bucket, gram, quality, row_number() OVER (PARTITION BY bucket ORDER BY quality DESC, gram DESC) AS rank FROM b"),
    "rescaled_top": with_base(f"{patterns(5)}, {QUALITY}, t AS (SELECT * FROM scored ORDER BY quality DESC, gram DESC LIMIT 300) SELECT gram, round(CASE WHEN max(quality) OVER () > min(quality) OVER () THEN (quality - min(quality) OVER ()) / (max(quality) OVER () - min(quality) OVER ()) ELSE 1.0 END, 6) AS quality FROM t"),
    "model_counts": with_base(f"{patterns(5)}, {QUALITY} SELECT count(*) FILTER (n = 1) AS n_unigram, count(*) FILTER (n > 1) AS n_multigram, max(n) AS max_len FROM scored WHERE quality > 0"),
    "unigram_overrides": with_base(f"""{patterns(1)}, {QUALITY}, t AS (SELECT gram, arg_min(tags, (sent_id, st)) AS tags FROM grams SEMI JOIN patterns USING (gram) GROUP BY gram)
      SELECT gram, CASE WHEN tags IN ('IN', 'TO', 'RP') OR starts_with(tags, 'VB') THEN 'RP' WHEN tags = 'PRP' THEN 'EP' ELSE indicator END AS indicator, CASE WHEN tags IN ('IN', 'TO', 'RP', 'PRP') THEN 1.0 ELSE quality END AS quality FROM scored JOIN t USING (gram)"""),
    "tag_transitions": with_base("p AS (SELECT tag AS tag_a, lead(tag) OVER (PARTITION BY sent_id ORDER BY pos) AS tag_b FROM toks), c AS (SELECT tag_a, tag_b, count(*) AS total FROM p WHERE tag_b IS NOT NULL GROUP BY ALL) SELECT tag_a, tag_b, total, round(total / sum(total) OVER (PARTITION BY tag_a), 6) AS p, round(1 - total / sum(total) OVER (PARTITION BY tag_a), 6) AS disconnect FROM c"),
    "bridged_transitions": with_base("p AS (SELECT tag AS tag_a, is_punc, lead(is_punc) OVER w AS p1, lead(is_punc, 2) OVER w AS p2, lead(tag, 2) OVER w AS tag_b FROM toks WINDOW w AS (PARTITION BY sent_id ORDER BY pos)) SELECT tag_a, tag_b, count(*) AS total FROM p WHERE NOT is_punc AND p1 AND NOT p2 GROUP BY ALL"),
    "noun_tag_patterns": with_base(f"{grams(5, words='gl')}, f AS (SELECT gram, count(*) AS freq FROM grams GROUP BY gram HAVING count(*) >= 10 ORDER BY freq DESC, gram LIMIT 200) SELECT gram, freq FROM f WHERE contains(gram, 'N') AND NOT contains(gram, 'V')"),
    "np_chunks": with_base(f"{CHUNKS} SELECT sent_id, st, n, text, tags FROM chunk"),
    "entity_counts": with_base(f"{CHUNKS} SELECT text, count(*) AS freq FROM chunk GROUP BY text HAVING count(*) > 9"),
    "frequency_bands": with_base(f"{CHUNKS} SELECT text, count(*) AS freq FROM chunk GROUP BY text HAVING (count(*) >= 5 AND contains(text, ' ')) OR (count(*) > 30 AND count(*) < 100)"),
    "relation_phrases": with_base(f"""{CHUNKS}, m AS (SELECT a.sent_id, a.st + a.n AS g, b.st - a.st - a.n AS k FROM chunk a JOIN chunk b ON a.sent_id = b.sent_id AND b.st >= a.st + a.n WHERE b.st - a.st - a.n >= 1),
      r AS (SELECT g, tl, array_to_string(gl[g + 1:g + k], ' ') || ' ' AS said FROM m JOIN sents USING (sent_id)), x AS (SELECT *, regexp_extract(said, '{RELATION}') AS hit FROM r),
      y AS (SELECT g, tl, hit, length(left(said, instr(said, hit) - 1)) - length(replace(left(said, instr(said, hit) - 1), ' ', '')) AS o, length(rtrim(hit)) - length(replace(rtrim(hit), ' ', '')) + 1 AS c FROM x WHERE hit <> '')
      SELECT array_to_string(tl[g + o + 1:g + o + c], ' ') AS text, count(*) AS freq FROM y GROUP BY text HAVING count(*) > 9"""),
    "dictionary_link": with_base(f"{patterns(5)} SELECT sent_id, st, st + n - 1 AS ed, gram FROM grams SEMI JOIN (SELECT gram FROM patterns WHERE n > 1 AND freq % 3 = 0) USING (gram)"),
    "seed_link": with_base(f"""{grams(5)}, sd AS (SELECT doc_id AS doc, array_to_string(list_transform(ws, lambda x: lower(x))[1:2], ' ') AS surface, 0.7 + (doc_id % 4) * 0.1 AS sim, CASE WHEN doc_id % 2 = 0 THEN 0.0001 ELSE 0.01 END AS second_rank FROM s0 WHERE sent_id % 100000 = 0 AND len(ws) > 1),
      good AS (SELECT DISTINCT doc, surface AS gram FROM sd WHERE sim > 0.8 AND second_rank < 0.001) SELECT sent_id, st, st + n - 1 AS ed, g.gram FROM grams g JOIN s0 USING (sent_id) JOIN good ON good.doc = s0.doc_id AND good.gram = g.gram"""),
    "mention_sets_diff": with_base(f"{CHUNKS}, a AS (SELECT sent_id, list(DISTINCT text) AS x FROM chunk GROUP BY sent_id), b AS (SELECT sent_id, list(DISTINCT text) AS y FROM chunk WHERE n > 1 GROUP BY sent_id) SELECT sent_id, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), '|') AS only_a, array_to_string(list_sort(list_filter(y, lambda t: NOT list_contains(x, t))), '|') AS only_b FROM a JOIN b USING (sent_id)"),
    "mention_prf": with_base(f"""{CHUNKS}, pred AS (SELECT sent_id, list(DISTINCT text) AS p FROM chunk WHERE n > 1 GROUP BY sent_id), gold AS (SELECT sent_id, list(DISTINCT text) AS g FROM chunk GROUP BY sent_id),
      c AS (SELECT coalesce(sum(coalesce(len(p), 0)), 0)::BIGINT AS n_pred, sum(len(g))::BIGINT AS n_gold, sum(coalesce(len(list_intersect(p, g)), 0))::BIGINT AS n_both FROM gold LEFT JOIN pred USING (sent_id))
      SELECT n_pred, n_gold, n_both, round(n_both / n_pred, 6) AS precision, round(n_both / n_gold, 6) AS recall, round(2 * (n_both / n_pred) * (n_both / n_gold) / (n_both / n_pred + n_both / n_gold), 6) AS f1 FROM c"""),
    "translation_rank": """WITH k AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT vec_id AS tuple_id, vec_id AS subj, vec_id + 1 AS obj, [vec_id + 2, vec_id + 3, -1] AS rels FROM k),
      r AS (SELECT tuple_id, unnest(rels) AS key FROM t), d AS (SELECT tuple_id, list(v) AS vs FROM r JOIN k ON k.vec_id = r.key GROUP BY tuple_id),
      x AS (SELECT t.tuple_id, s.v AS a, o.v AS b, vs FROM t JOIN k s ON s.vec_id = t.subj JOIN k o ON o.vec_id = t.obj JOIN d ON d.tuple_id = t.tuple_id)
      SELECT tuple_id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] + list_sum(list_transform(vs, lambda z: z[i])) / len(vs) - b[i]))), 4) AS score FROM x""",
    "ordered_merge": "WITH a AS (SELECT conv_id AS doc, turn AS ord, text FROM conversations WHERE role = 'user'), b AS (SELECT conv_id AS doc, turn AS ord, text FROM conversations WHERE role <> 'user') SELECT doc, ord, 0 AS side, text FROM b SEMI JOIN a USING (doc) UNION ALL SELECT doc, ord, 1, text FROM a",
    "underscored_phrases": with_base(f"{patterns(5)} SELECT gram, replace(gram, ' ', '_') AS phrase, CASE WHEN n > 2 THEN freq + 3.0 ELSE freq END AS score, array_to_string(list_transform(string_split(gram, ' '), lambda x, i: (i - 1)::VARCHAR || '_' || x), ' ') AS indexed, regexp_replace(gram, '[^\\x00-\\x7F]', '', 'g') AS ascii FROM patterns"),
    "verbal_tuples": with_base(f"{patterns(5)}, t AS (SELECT gram, arg_min(tags, (sent_id, st)) AS tags FROM grams SEMI JOIN patterns USING (gram) GROUP BY gram) SELECT string_split(gram, ' ')[1] AS subj, string_split(gram, ' ')[3] AS obj, string_split(tags, ' ')[2] AS rel_tags FROM t WHERE len(string_split(gram, ' ')) = 3 AND (contains(string_split(tags, ' ')[2], 'VB') OR contains(string_split(tags, ' ')[2], 'IN'))"),
    "linked_types": "WITH l AS (SELECT page_id AS doc, url AS uri FROM pages), i AS (SELECT DISTINCT url AS uri, regexp_extract(url, '://([^/]*)', 1) AS kb_id FROM pages), t AS (SELECT DISTINCT regexp_extract(url, '://([^/]*)', 1) AS kb_id, regexp_extract(url, '://[^/]*/([a-z]+)', 1) AS type FROM pages), g AS (SELECT kb_id, array_to_string(list_sort(list(DISTINCT type)), ' ') AS types FROM t GROUP BY kb_id) SELECT doc, kb_id AS surface, types FROM l JOIN i USING (uri) JOIN g USING (kb_id)",
    "sentence_split": r"WITH c AS (SELECT doc_id, regexp_replace(text, '[\t\n\r_]', ' ', 'g') AS t FROM documents), s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '([^.!?;:]*(?:\.|[!?;:]+|$))', 1), lambda x: trim(x)), lambda x: x <> '') AS l FROM c) SELECT doc_id, len(l) AS n_sentences, md5(array_to_string(l, chr(10))) AS digest FROM s",
    "viterbi_segments": with_base(f"{VITERBI}, a AS (SELECT sent_id, string_agg(st::VARCHAR || '-' || ed::VARCHAR, ' ' ORDER BY st) AS segments FROM segs GROUP BY sent_id) SELECT sent_id, round(score, 4) AS score, segments FROM final JOIN a USING (sent_id)", True),
    "rectified_freq": with_base(f"{VITERBI}, c AS (SELECT array_to_string(tl[st + 1:ed], ' ') AS gram, count(*) AS k FROM segs JOIN sents USING (sent_id) GROUP BY 1) SELECT p.gram, p.n, coalesce(k, 0) AS freq FROM patterns p LEFT JOIN c USING (gram)", True),
}
