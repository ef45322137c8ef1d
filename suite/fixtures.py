"""Derived tables, as SQL that Spark and DuckDB read alike: integer arithmetic on the keys of the given tables."""

N = "chr(10)"


def pad(expression: str, width: int) -> str:
    return f"lpad(cast({expression} as string), {width}, '0')"


def luhn_digit(body: str) -> str:
    """Check digit of a 15-digit string: every other digit doubled, from the first."""
    terms = []
    for i in range(1, 16):
        d = f"cast(substr({body}, {i}, 1) as int)"
        terms.append(f"(case when {d} > 4 then {d} * 2 - 9 else {d} * 2 end)" if i % 2 else d)
    return f"cast((10 - ({' + '.join(terms)}) % 10) % 10 as string)"


def nir_body(k: str) -> str:
    return " || ".join([
        f"cast(1 + {k} % 2 as string)", pad(f"50 + {k} % 50", 2), pad(f"1 + {k} % 12", 2), pad(f"1 + {k} % 19", 2),
        pad(f"{k} % 990 + 1", 3), pad(f"({k} * 7) % 990 + 1", 3),
    ])


def iban_check(bban: str) -> str:
    """Check digits of FR + 23 digits: mod 97 in parts that fit in 64 bits (F = 15, R = 27)."""
    a, b = f"cast(substr({bban}, 1, 11) as bigint)", f"cast(substr({bban}, 12, 12) as bigint)"
    return pad(f"98 - (((({a} % 97) * 1000000000000 + {b}) % 97) * 1000000 + 152700) % 97", 2)


def grouped(value: str, *sizes: int) -> str:
    parts, at = [], 1
    for size in sizes:
        parts.append(f"substr({value}, {at}, {size})")
        at += size
    return " || ' ' || ".join(parts)


PEOPLE = """
select * from (values
  (0, 'Jeanne', 'Morel'), (1, 'Luc', 'Bertin'), (2, 'Hélène', 'Dufour'), (3, 'Paul', 'Castel'),
  (4, 'Inès', 'Robin'), (5, 'Marc-Antoine', 'Vidal'), (6, 'Zoé', 'Perrot')
) as p(i, first_name, last_name)
"""
CITIES = """
select * from (values
  (0, '44000', 'Nantes'), (1, '29200', 'Brest'), (2, '87000', 'Limoges'), (3, '63000', 'Clermont-Ferrand'),
  (4, '83000', 'Toulon')
) as c(i, postcode, city)
"""

LETTER_TYPES = [
    "PERSON", "FR_ADDRESS", "PHONE_NUMBER", "EMAIL_ADDRESS", "FR_NIR", "FR_FISCAL_NUMBER", "IBAN_CODE", "CREDIT_CARD",
    "IP_ADDRESS",
]
LETTER_PLAIN = [
    "'Dossier ' || cast(k as string) || ' suivi par M. '", "', domicile au '", f"'.' || {N} || 'On peut me joindre au '",
    "' ou par courriel : '", f"'.' || {N} || 'Numéro de sécurité sociale : '", "', numéro fiscal : '",
    f"'.' || {N} || 'Virement sur le compte '", "' ou carte '", "', depuis le poste '",
]
_prefix = [
    " || ".join(f"p{j} || v{j}" for j in range(i)) + (" || " if i else "") + f"p{i}" for i in range(len(LETTER_TYPES))
]

FIXTURES = {
    "fx_people": PEOPLE,
    "fx_cities": CITIES,
    # One identifier per customer, one in five with a wrong key.
    "fx_nir": f"""
select k as doc_id, 'fr' as lang, k % 5 <> 0 as valid,
  case when k % 2 = 0 then {grouped('number', 1, 2, 2, 2, 3, 3, 2)} else number end as value,
  'N° de sécurité sociale : ' || case when k % 2 = 0 then {grouped('number', 1, 2, 2, 2, 3, 3, 2)} else number end || '.' as text
from (select k, body || {pad("case when k % 5 <> 0 then good when good = 97 then 1 else good + 1 end", 2)} as number
  from (select k, body, 97 - cast(body as bigint) % 97 as good
    from (select c_custkey as k, {nir_body('c_custkey')} as body from customer) b) g) n""",
    "fx_fiscal": f"""
select k as doc_id, 'fr' as lang, k % 5 <> 0 as valid, value, 'Mon numéro fiscal est ' || value || ', merci.' as text
from (select k, case when k % 2 = 0 then {grouped('number', 2, 2, 3, 3, 3)} else number end as value
  from (select k, body || {pad("(cast(body as bigint) % 511 + case when k % 5 = 0 then 1 else 0 end) % 1000", 3)} as number
    from (select c_custkey as k, cast(c_custkey % 4 as string) || {pad('(c_custkey * 7919) % 1000000000', 9)} as body
      from customer) b) n) v""",
    "fx_card": f"""
select k as doc_id, 'fr' as lang, k % 5 <> 0 as valid, value, 'Ma carte ' || value || ' a été débitée.' as text
from (select k, case k % 3 when 0 then number when 1 then {grouped('number', 4, 4, 4, 4)}
    else replace({grouped('number', 4, 4, 4, 4)}, ' ', '-') end as value
  from (select k, body || cast((cast({luhn_digit('body')} as int) + case when k % 5 = 0 then 1 else 0 end) % 10 as string) as number
    from (select c_custkey as k, case c_custkey % 4 when 0 then '4' || {pad('(c_custkey * 104729) % 100000000000000', 14)}
        when 1 then '51' || {pad('(c_custkey * 104729) % 10000000000000', 13)}
        when 2 then '2221' || {pad('(c_custkey * 104729) % 100000000000', 11)}
        else '2720' || {pad('(c_custkey * 104729) % 100000000000', 11)} end as body from customer) b) n) v""",
    "fx_iban": f"""
select k as doc_id, 'fr' as lang, k % 5 <> 0 as valid, value, 'Virement sur ' || value || ' avant vendredi.' as text
from (select k, case when k % 2 = 0 then {grouped('number', 4, 4, 4, 4, 4, 4, 3)} else number end as value
  from (select k, 'FR' || {pad("case when k % 5 <> 0 then good when good = 98 then 2 else good + 1 end", 2)} || bban as number
    from (select k, bban, cast({iban_check('bban')} as int) as good
      from (select c_custkey as k, {pad('(c_custkey * 99991) % 100000000000', 11)} || {pad('(c_custkey * 7717) % 1000000000000', 12)} as bban
        from customer) b) g) n) v""",
    "fx_phone": f"""
select k as doc_id, 'fr' as lang, n as national, value, 'Appelez le ' || value || ' demain.' as text
from (select k, n, case k % 5
    when 0 then '0' || {grouped('n', 1, 2, 2, 2, 2).replace("substr(n, 1, 1) || ' ' ||", "substr(n, 1, 1) ||", 1)}
    when 1 then '0' || n
    when 2 then '+33 ' || {grouped('n', 1, 2, 2, 2, 2)}
    when 3 then '+33 (0)' || {grouped('n', 1, 2, 2, 2, 2)}
    else '0033 ' || {grouped('n', 1, 2, 2, 2, 2)} end as value
  from (select c_custkey as k, cast(1 + c_custkey % 9 as string) || {pad('(c_custkey * 48611 + 1234567) % 100000000', 8)} as n
    from customer) d) v""",
    # Full letters: nine typed values, every key right.
    "fx_parts": f"""
select c_custkey as k, {', '.join(f'{p.replace("cast(k as", "cast(c_custkey as")} as p{i}' for i, p in enumerate(LETTER_PLAIN))},
  f.first_name || ' ' || l.last_name as v0,
  cast(1 + c_custkey % 180 as string) || case when c_custkey % 4 = 0 then ' bis' else '' end || case c_custkey % 3 when 0 then ' rue des Acacias'
    when 1 then ', avenue du Port' else ' chemin de la Fontaine' end || ', ' || t.postcode || ' ' || t.city as v1,
  '06 ' || {grouped('x8', 2, 2, 2, 2)} as v2,
  lower(translate(f.first_name, 'éèÉ', 'eeE')) || '.' || lower(l.last_name) || '@example.' || case when c_custkey % 2 = 0 then 'fr' else 'org' end as v3,
  {grouped("nir", 1, 2, 2, 2, 3, 3, 2)} as v4,
  {grouped("fiscal", 2, 2, 3, 3, 3)} as v5,
  'FR' || iban_key || bban as v6,
  {grouped("card", 4, 4, 4, 4)} as v7,
  '10.' || cast(c_custkey % 250 as string) || '.' || cast((c_custkey * 7) % 250 as string) || '.' || cast(1 + c_custkey % 9 as string) as v8,
  t.postcode || ' ' || t.city as town
from (select c_custkey, x8, bban, nir_body || {pad('97 - cast(nir_body as bigint) % 97', 2)} as nir,
    fiscal_body || {pad('cast(fiscal_body as bigint) % 511', 3)} as fiscal,
    {iban_check('bban')} as iban_key, card_body || {luhn_digit('card_body')} as card
  from (select c_custkey, '1' || {pad('(c_custkey * 48611) % 10000000', 7)} as x8, {nir_body('c_custkey')} as nir_body,
      cast(c_custkey % 4 as string) || {pad('(c_custkey * 7919) % 1000000000', 9)} as fiscal_body,
      {pad('(c_custkey * 99991) % 100000000000', 11)} || {pad('(c_custkey * 7717) % 1000000000000', 12)} as bban,
      '4' || {pad('(c_custkey * 104729) % 100000000000000', 14)} as card_body from customer) a) b
join fx_people f on f.i = c_custkey % 7 join fx_people l on l.i = (c_custkey + 3) % 7 join fx_cities t on t.i = c_custkey % 5""",
    "fx_letters": f"""
select k as doc_id, 'fr' as lang, {' || '.join(f'p{i} || v{i}' for i in range(9))} || '.' as text from fx_parts""",
    "fx_gold": " union all ".join(
        f"select k as doc_id, '{t}' as entity_type, cast(length({_prefix[i]}) as int) as start, "
        f"cast(length({_prefix[i]} || v{i}) as int) as \"end\", v{i} as value from fx_parts"
        for i, t in enumerate(LETTER_TYPES)
    ),
    # Predictions: gold without every seventh text, shifted by 2 in every fifth, another type in every eleventh.
    "fx_pred": """
select doc_id, case when doc_id % 11 = 0 then 'LOCATION' else entity_type end as entity_type,
  cast(start + case when doc_id % 5 = 0 then 2 else 0 end as int) as start,
  cast("end" + case when doc_id % 5 = 0 then 2 else 0 end as int) as "end", 0.85e0 as score
from fx_gold where doc_id % 7 <> 0
union all select doc_id, 'LOCATION', cast(0 as int), cast(7 as int), 0.85e0 from fx_gold where entity_type = 'PERSON' and doc_id % 3 = 0
union all select doc_id, 'PERSON', cast(-1 as int), cast(-1 as int), 1.0e0 from fx_gold where entity_type = 'PERSON' and doc_id % 13 = 0""",
    "fx_annotated_counts": "select doc_id, count(*) as n from fx_gold group by doc_id",
    "fx_names": f"""
select k as doc_id, 'fr' as lang, pre, name, kind, pre || name || post as text from (
  select c_custkey as k, c_custkey % 5 as kind,
    case c_custkey % 5 when 0 then '' when 1 then 'Bien à vous,' || {N} when 2 then 'Le dossier de '
      when 3 then 'Un rendez-vous pour ' else 'Madame, Monsieur, merci de joindre ' end as pre,
    case c_custkey % 5 when 0 then f.first_name || ' ' || l.last_name when 1 then f.first_name when 2 then f.first_name || ' de ' || l.last_name
      when 3 then f.first_name else 'Numéro Vert' end as name,
    case c_custkey % 5 when 0 then {N} || '3 quai du Port' when 1 then '' when 2 then ' est complet.' when 3 then ' demain.' else '' end as post
  from customer join fx_people f on f.i = c_custkey % 7 join fx_people l on l.i = (c_custkey + 3) % 7) x""",
    "fx_census": """
select case c_custkey % 11 when 7 then '_PRENOMS_RARES' when 8 then 'PARIS' when 9 then 'LÉA-ROSE' when 10 then 'D''ARCY'
    else upper(coalesce(f.first_name, 'Rare')) end as preusuel,
  cast(c_custkey % 40 as int) as nombre, cast(1 + c_custkey % 2 as int) as sexe, cast(1950 + c_custkey % 60 as string) as annee
from customer left join fx_people f on f.i = c_custkey % 11""",
    "fx_first_names": "select first_name as name from fx_people",
    # Conversations with a person and an e-mail address added to every message; they repeat inside a conversation.
    "fx_added": f"""
select conv_id, turn, role, text as body, f.first_name || ' ' || l.last_name as person,
  lower(translate(f.first_name, 'éèÉ', 'eeE')) || '@example.org' as email
from conversations join fx_people f on f.i = (conv_id + turn % 3) % 7 join fx_people l on l.i = (conv_id + 2 * (turn % 3)) % 7""",
    "fx_conversations": f"""
select conv_id, turn, role, body || {N} || 'M. ' || person || ' (' || email || ')' as text from fx_added""",
    "fx_conv_spans": f"""
select conv_id, cast(turn as bigint) as turn, 'PERSON' as entity_type, cast(length(body) + 4 as int) as start,
  cast(length(body) + 4 + length(person) as int) as "end", person as value from fx_added
union all
select conv_id, cast(turn as bigint) as turn, 'EMAIL_ADDRESS', cast(length(body) + 6 + length(person) as int),
  cast(length(body) + 6 + length(person) + length(email) as int), email from fx_added""",
    # Calls: one per event.
    "fx_aliases": """
select * from (values
  ('view', 'local_chat/small:1b', 'local', 0.0000001, 0.0000004, null),
  ('click', 'local_chat/large:7b', 'local', 0.0000005, 0.0000020, null),
  ('error', 'hosted/pro-24b', 'hosted', 0.0000015, 0.0000035, null),
  ('signup', 'local/embedder:278m', 'local', 0.0000002, null, null),
  ('purchase', 'hub/reranker', 'hub', null, null, 0.001)
) as a(alias, model, provider, price_in, price_out, price_query)""",
    "fx_teams": """
select * from (values
  ('f', 'Forecast', 0.05, 'optional', 2, 1000), ('m', 'Manuals', 0.04, 'optional', 1, 800),
  ('b', 'Billing', 0.02, 'required', 3, 900), ('s', 'Support', 0.10, 'required', 1, 500)
) as t(team_id, team_alias, max_budget, pii_masking, rpm_limit, tpm_limit)""",
    "fx_access": """
select * from (values ('f', 'view'), ('f', 'click'), ('f', 'error'), ('f', 'signup'), ('f', 'purchase'), ('m', 'view'),
  ('m', 'click'), ('b', 'click'), ('b', 'signup'), ('b', 'error'), ('s', 'view'), ('s', 'click'), ('s', 'error')) as x(team_id, alias)""",
    "fx_calls": """
select event_id as call_id, ts, case when event_id % 50 = 0 then null when user_id % 4 = 0 then 'f' when user_id % 4 = 1 then 'm'
    when user_id % 4 = 2 then 'b' else 's' end as team,
  event_type as alias, k * 10 as tokens_in, k as tokens_out, value as latency,
  case when event_id % 97 = 0 then 500 when event_id % 89 = 0 then 429 else 200 end as status,
  case when event_id % 3 = 0 then 'worker' else 'app' end as end_user, event_id % 7 = 0 as asks_masking
from (select *, cast(substr(props, 7, length(props) - 7) as bigint) as k from events) e""",
    "fx_priced": """
select c.*, a.provider, a.model, cast(c.tokens_in * cast(coalesce(a.price_in, 0) as decimal(18,10)) + c.tokens_out * cast(coalesce(a.price_out, 0) as decimal(18,10))
  + cast(coalesce(a.price_query, 0) as decimal(18,10)) as decimal(30,10)) as cost
from fx_calls c join fx_aliases a on a.alias = c.alias""",
    # Detections that overlap in every way: inside another type or the same one, equal, partly, touching.
    "fx_spans": """
select doc_id, entity_type, start, "end", case entity_type when 'FR_ADDRESS' then 0.6e0 when 'PHONE_NUMBER' then 0.4e0 when 'IP_ADDRESS' then 0.3e0 else 0.85e0 end as score,
  'a' as recognizer, case when entity_type in ('FR_NIR', 'IBAN_CODE') then doc_id % 5 <> 0 end as checksum from fx_gold
union all select doc_id, 'LOCATION', cast(start + 3 as int), cast("end" - 2 as int), 0.85e0, 'b', null from fx_gold where entity_type = 'FR_ADDRESS'
union all select doc_id, 'FR_ADDRESS', cast(start + 3 as int), cast("end" - 2 as int), 0.95e0, 'b', null from fx_gold where entity_type = 'FR_ADDRESS' and doc_id % 2 = 0
union all select doc_id, 'CREDIT_CARD', start, "end", 0.85e0, 'b', null from fx_gold where entity_type = 'FR_FISCAL_NUMBER'
union all select doc_id, 'LOCATION', cast(start + 2 as int), cast("end" + 4 as int), 0.45e0, 'b', null from fx_gold where entity_type = 'PERSON'
union all select doc_id, 'PERSON', "end", cast("end" + 3 as int), 0.5e0, 'b', null from fx_gold where entity_type = 'EMAIL_ADDRESS'
union all select doc_id, 'PHONE_NUMBER', cast(start + 1 as int), cast("end" - 1 as int), 0.4e0, 'b', null from fx_gold where entity_type = 'PHONE_NUMBER'
union all select doc_id, 'LOCATION', start, cast(start + 4 as int), 0.85e0, 'b', null from fx_gold where entity_type = 'IBAN_CODE'""",
    # Values that a model quotes: as they are, in capitals, or invented.
    "fx_quoted": """
select doc_id, entity_type, case when doc_id % 3 = 1 then upper(value) when doc_id % 3 = 2 and entity_type = 'PERSON' then 'Nobody Here' else value end as value
from fx_gold where entity_type in ('PERSON', 'EMAIL_ADDRESS', 'IP_ADDRESS')
union all select doc_id, 'DIGITS', '00' from fx_gold where entity_type = 'CREDIT_CARD'""",
    "fx_policy": """
select * from (values ('PERSON', 0.4), ('LOCATION', 0.4), ('FR_ADDRESS', 0.4), ('EMAIL_ADDRESS', 0.4), ('PHONE_NUMBER', 0.4),
  ('IBAN_CODE', 0.4), ('CREDIT_CARD', 0.4), ('CRYPTO', 0.4), ('IP_ADDRESS', 0.4), ('FR_NIR', 0.4), ('FR_FISCAL_NUMBER', 0.4)) as p(entity_type, threshold)""",
    "fx_merged": """
select doc_id, min(start) as start, max("end") as "end" from (
  select *, sum(fresh) over (partition by doc_id order by start, "end" rows between unbounded preceding and current row) as island from (
    select doc_id, start, "end", case when start < max("end") over (partition by doc_id order by start, "end" rows between unbounded preceding and 1 preceding)
      then 0 else 1 end as fresh from fx_spans) f) i group by doc_id, island""",
    # Markers of the conversations: first occurrence of each value numbers it.
    "fx_markers": """
select conv_id, value, '<' || entity_type || '_' || cast(n as string) || '>' as marker, cast(n as bigint) as n from (
  select *, row_number() over (partition by conv_id order by turn, start) as n from (
    select *, row_number() over (partition by conv_id, value order by turn, start) as seen from fx_conv_spans) s where seen = 1) f""",
    # Answers that name markers of their conversation, one that does not exist, and one that runs into another.
    "fx_answers": """
select conv_id * 1000 + turn as answer_id, conv_id, 'Re <PERSON_1>: ' || text || ' <EMAIL_ADDRESS_2> <PERSON_10> <PERSON_3> <NOT_A_MARKER> <PERSON_1>' as text
from conversations where role = 'assistant'""",
    "fx_requests": "select call_id, team, asks_masking from fx_calls",
    "fx_caps": "select * from (values ('hosted', 0.02), ('hub', 1.2)) as c(provider, cap)",
    "fx_routes": "select * from (values ('f', 'forecast'), ('m', 'manuals'), ('b', 'billing')) as r(team, project)",
    "fx_members": """
select * from (values ('lead-f', 'f'), ('lead-m', 'm'), ('lead-bs', 'b'), ('lead-bs', 's'), ('admin', '*')) as m(account, team)""",
    "fx_history": """
select * from (values
  ('view', timestamp '2024-01-03 00:00:00', 0.0000001, 0.0000004), ('view', timestamp '2024-01-15 12:00:00', 0.0000002, 0.0000005),
  ('click', timestamp '2024-01-01 00:00:00', 0.0000005, 0.0000020), ('click', timestamp '2024-01-20 00:00:00', 0.0000007, 0.0000030),
  ('error', timestamp '2023-12-01 00:00:00', 0.0000015, 0.0000035)) as h(alias, valid_from, price_in, price_out)""",
    # The name a trace carries: alias, model, or provider/model, in any case.
    "fx_traced": """
select c.call_id, c.team, case c.call_id % 5 when 0 then c.alias when 1 then upper(c.alias) when 2 then a.model
  when 3 then upper(a.model) else 'unknown:1b' end as traced_model
from fx_calls c join fx_aliases a on a.alias = c.alias""",
    "fx_served": """
select call_id, alias, latency, case when alias = 'click' and call_id % 11 = 0 then 'view' else alias end as served_alias from fx_calls""",
    "fx_json": """
select event_id as answer_id, case event_id % 8
  when 0 then '{"query": "late ' || event_type || '", "season": 2024, "variants": ["a", "b"]}'
  when 1 then '{"query": "q", "season": null, "variants": ["a", "b"]}'
  when 2 then '{"query": "q", "season": "2024", "variants": ["a", "b"]}'
  when 3 then '{"query": "q", "season": 2024, "variants": ["a"]}'
  when 4 then '{"query": "q", "season": 2024'
  when 5 then '{"season": 2024, "variants": ["a", "b"]}'
  when 6 then '["query"]'
  else 'Here is your JSON: {"query": "q"}' end as content from events""",
    "fx_tool_calls": """
select event_id as answer_id, case when event_id % 9 = 0 then 'get_weather' else 'get_race' end as tool, case event_id % 5
  when 0 then '{"season": ' || cast(2000 + user_id as string) || ', "name": "Monza"}' when 1 then '{"season": "soon", "name": "Spa"}' when 2 then '{"name": "Spa"}'
  when 3 then '{"season": 2024, "name": ' else '{"season": 2024, "name": "Spa", "extra": true}' end as arguments from events""",
    "fx_attempts": """
select cast((event_id - event_id % 5) / 5 as bigint) as job_id, event_id as attempt_id, ts, case when user_id % 4 = 0 then 'f' else 'm' end as team, event_type as alias, value as seconds,
  cast(case event_id % 11 when 0 then 200 when 1 then 200 when 2 then 500 when 3 then 429 when 4 then 408 when 5 then 403 when 6 then 400 when 7 then 503 when 8 then null when 9 then 429 else 429 end as int) as status,
  case event_id % 4 when 0 then '2024-01-15 00:00:30 UTC' when 1 then 'soon' end as reset_at,
  case event_id % 3 when 0 then '12' when 1 then 'later' end as retry_after
from events""",
    "fx_job_messages": """
select event_id as message_id, 'reply-' || event_type as reply_to, case event_id % 12
  when 0 then '{"id": "j' || cast(event_id as string) || '", "team": "f", "alias": "' || event_type || '", "messages": [{"role": "user", "content": "Hi"}]}'
  when 1 then '{"id": 7, "team": "m", "alias": "a", "messages": [{"role": "user", "content": "Hi"}], "max_tokens": 64}'
  when 2 then 'not json' when 3 then '[]' when 4 then '{"alias": "a", "messages": [{"role": "user"}]}' when 5 then '{"team": "f", "messages": [{"role": "user"}]}'
  when 6 then '{"team": "f", "alias": "a", "messages": []}' when 7 then '{"team": "f", "alias": "a", "messages": [{"role": "user"}], "max_tokens": 4097}'
  when 8 then '{"team": "f", "alias": "a", "messages": [{"role": "user"}], "max_tokens": "512"}' when 9 then '{"team": "", "alias": "a", "messages": [1]}'
  when 10 then '{"team": "x", "alias": "a", "messages": [{"role": "user", "content": "Hi"}], "max_tokens": 4096}'
  else '{"team": "f", "alias": "a", "messages": "Hi"}' end as body from events""",
    # Declared suppliers, and an actual state: every ninth missing, one field changed in every fourth, extra rows.
    "fx_declared": "select s_suppkey as id, s_name as name, s_nationkey as nation, case when s_suppkey % 6 = 0 then null else s_acctbal end as balance from supplier",
    "fx_actual": """
select s_suppkey as id, s_name as name, case when s_suppkey % 4 = 0 then s_nationkey + 1 else s_nationkey end as nation,
  case when s_suppkey % 6 in (0, 1) then null else s_acctbal end as balance from supplier where s_suppkey % 9 <> 0
union all select s_suppkey + 1000000, 'extra', 0, 0.0 from supplier where s_suppkey % 7 = 0""",
    "fx_keys": "select 'team' || cast(s_suppkey as string) as team_id, case when s_suppkey % 10 = 0 then 'pk-' else 'sk-' end || s_name || '-' || cast(s_suppkey * 7919 as string) as value from supplier",
}
