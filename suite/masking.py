"""Queries of the span algebra and masking families."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.operators import detect as d
from maskline.operators import mask as m
from maskline.operators import spans as s
from maskline.plans.masking import mask_conversations
from suite.registry import query


@query("apply_check_digits", """select doc_id, entity_type, start, "end", case when checksum then 1.0 else score end as score, recognizer, checksum
from fx_spans where checksum is null or checksum""")
def apply_check_digits(t):
    return s.apply_check_digits(t("fx_spans"))


_WORDS = {"a": fixed.CONTEXT_PHONE_FR, "b": ["rue", "avenue"]}


@query("boost_by_context", """
select doc_id, entity_type, start, "end", recognizer, checksum, word as context_word,
  case when word is null then score else least(greatest(score + 0.35, 0.4), 1.0) end as score
from (select s.*, list_filter([{lists}], lambda w: list_bool_or(list_transform(near, lambda x: contains(x, w.word))) and w.recognizer = s.recognizer)[1].word as word
  from (select s.*, list_concat(
      list_reverse(list_reverse(regexp_extract_all(lower(substr(l.text, 1, s.start)), '[0-9a-zà-öø-ÿ_]+'))[1:5]),
      regexp_extract_all(lower(substr(l.text, s.start + 1, s."end" - s.start)), '[0-9a-zà-öø-ÿ_]+')[1:1]) as near
    from fx_spans s join fx_letters l on l.doc_id = s.doc_id) s) w""".replace("{lists}", ", ".join(
    f"{{'recognizer': '{r}', 'word': '{w}'}}" for r, words in _WORDS.items() for w in words)))
def boost_by_context(t):
    return s.boost_by_context(t("fx_letters"), t("fx_spans"), _WORDS)


@query("filter_spans", """select s.* from fx_spans s join fx_policy p on p.entity_type = s.entity_type where s.score >= p.threshold""")
def filter_spans(t):
    return s.filter_spans(t("fx_spans"), t("fx_policy"))


@query("drop_contained", """select * from fx_spans a where not exists (select 1 from fx_spans b where b.doc_id = a.doc_id and b.entity_type = a.entity_type
  and b.start <= a.start and b."end" >= a."end" and (b.score > a.score or (b.score = a.score and (b.start < a.start or (b.start = a.start and b."end" > a."end")))))""")
def drop_contained(t):
    return s.drop_contained(t("fx_spans"))


_MAIN = """select m.doc_id, m.start, m."end", s.entity_type, s.score from fx_merged m join (
  select m.doc_id, m.start as at, s.entity_type, s.score, row_number() over (partition by m.doc_id, m.start
    order by s."end" - s.start desc, s.score desc, s.entity_type desc) as r
  from fx_merged m join fx_spans s on s.doc_id = m.doc_id and s.start >= m.start and s."end" <= m."end") s
on s.doc_id = m.doc_id and s.at = m.start where s.r = 1"""


@query("merge_overlaps", _MAIN)
def merge_overlaps(t):
    return s.merge_overlaps(t("fx_spans"))


@query("locate_values", """
select doc_id, entity_type, value, cast(coalesce(p - 1, -1) as int) as start, cast(coalesce(p - 1 + length(value), -1) as int) as "end" from (
  select doc_id, entity_type, value, unnest(case when len(exact) > 0 then exact when len(folded) > 0 then folded else [null] end) as p from (
    select q.doc_id, q.entity_type, q.value,
      list_filter(range(1, length(l.text) + 1), lambda i: substr(l.text, i, length(q.value)) = q.value) as exact,
      list_filter(range(1, length(l.text) + 1), lambda i: substr(lower(l.text), i, length(q.value)) = lower(q.value)) as folded
    from fx_quoted q join fx_letters l on l.doc_id = q.doc_id) x) y""")
def locate_values(t):
    return s.locate_values(t("fx_letters"), t("fx_quoted"))


@query("assign_markers", "select * from fx_markers")
def assign_markers(t):
    return m.assign_markers(t("fx_conv_spans"))


_MASKED = """select c.conv_id, c.turn, c.body || chr(10) || 'M. ' || p.marker || ' (' || e.marker || ')' as masked_text
from fx_added c join fx_markers p on p.conv_id = c.conv_id and p.value = c.person join fx_markers e on e.conv_id = c.conv_id and e.value = c.email"""


@query("apply_markers", _MASKED)
def apply_markers(t):
    marked = t("fx_conv_spans").join(t("fx_markers"), ["conv_id", "value"]).select("conv_id", "turn", "start", "end", "marker")
    return m.apply_markers(t("fx_conversations"), marked, ["conv_id", "turn"]).select("conv_id", "turn", "masked_text")


@query("mask_conversations", _MASKED)
def mask_conversations_query(t):
    masked, _ = mask_conversations(t("fx_conversations"), t("fx_first_names"))
    return masked.select("conv_id", "turn", "masked_text")


@query("unmask_answers", """
select a.answer_id, a.conv_id, a.text, replace(replace(replace(replace(a.text,
  '<PERSON_1>', coalesce(m1.value, '<PERSON_1>')), '<EMAIL_ADDRESS_2>', coalesce(m2.value, '<EMAIL_ADDRESS_2>')),
  '<PERSON_3>', coalesce(m3.value, '<PERSON_3>')), '<PERSON_10>', coalesce(m10.value, '<PERSON_10>')) as unmasked_text
from fx_answers a left join fx_markers m1 on m1.conv_id = a.conv_id and m1.marker = '<PERSON_1>'
left join fx_markers m2 on m2.conv_id = a.conv_id and m2.marker = '<EMAIL_ADDRESS_2>'
left join fx_markers m3 on m3.conv_id = a.conv_id and m3.marker = '<PERSON_3>'
left join fx_markers m10 on m10.conv_id = a.conv_id and m10.marker = '<PERSON_10>'""")
def unmask_answers(t):
    return m.unmask_answers(t("fx_answers"), t("fx_markers"))


_CHUNKS = " union all ".join(
    f"select conv_id * 1000 + turn as answer_id, conv_id, {i} as seq, {chunk} as chunk from conversations where role = 'user'"
    for i, chunk in enumerate(["'Dear <PER'", "'SON_1>, '", "text", "' <EMAIL_ADDR' || 'ESS_2>'"])
)


UNMASKED = """
select c.conv_id * 1000 + turn as answer_id, c.conv_id, 'Dear <PERSON_1>, ' || text || ' <EMAIL_ADDRESS_2>' as text,
  'Dear ' || coalesce(m1.value, '<PERSON_1>') || ', ' || text || ' ' || coalesce(m2.value, '<EMAIL_ADDRESS_2>') as unmasked_text
from conversations c left join fx_markers m1 on m1.conv_id = c.conv_id and m1.marker = '<PERSON_1>'
left join fx_markers m2 on m2.conv_id = c.conv_id and m2.marker = '<EMAIL_ADDRESS_2>' where role = 'user'"""


@query("unmask_chunks", UNMASKED)
def unmask_chunks(t):
    """Batch twin of the streamed operator: the same chunks, joined in order, then unmasked."""
    return m.unmask_chunks(t.sql(_CHUNKS), t("fx_markers"))


@query("masked_entity_count", """select conv_id, entity_type, count(*) as masked from fx_conv_spans group by conv_id, entity_type""")
def masked_entity_count(t):
    from maskline.plans.masking import message_spans

    spans = message_spans(t("fx_conversations"), t("fx_first_names"))
    return m.masked_entity_count(spans.select(F.col("doc_id.conv_id").alias("conv_id"), "entity_type"))


_PLAIN = "Dossier ' || cast(k as string) || ' suivi par M. <PERSON>, domicile au <FR_ADDRESS>.' || chr(10) || 'On peut me joindre au <PHONE_NUMBER> ou par courriel : <EMAIL_ADDRESS>.' || chr(10) || 'Numéro de sécurité sociale : <FR_NIR>, numéro fiscal : <FR_FISCAL_NUMBER>.' || chr(10) || 'Virement sur le compte <IBAN_CODE> ou carte <CREDIT_CARD>, depuis le poste <IP_ADDRESS>."


@query("anonymize_plain", f"select k as doc_id, '{_PLAIN}' as masked_text from fx_parts")
def anonymize_plain(t):
    found = d.detect_all(t("fx_letters"), t("fx_first_names"), fixed.MASKED_ENTITIES)
    merged = s.merge_overlaps(s.drop_contained(found).where(F.col("score") >= fixed.SCORE_THRESHOLD))
    return m.anonymize_plain(t("fx_letters"), merged).select("doc_id", "masked_text")


@query("masking_decision", """select r.*, t.pii_masking, case when t.pii_masking = 'optional' then r.asks_masking else true end as masked
from fx_requests r left join fx_teams t on t.team_id = r.team""")
def masking_decision(t):
    return m.masking_decision(t("fx_requests"), t("fx_teams"))


@query("redact_messages", """select event_id, 'redacted' as input, 'redacted' as output, event_type as team_kept, 2 as n_entries from events""")
def redact_messages(t):
    calls = t("events").select(
        "event_id", F.col("props").alias("input"), F.col("event_type").alias("output"),
        F.create_map(F.lit("team"), "event_type", F.lit("tokens"), F.col("user_id").cast("string"), F.lit("message"), "props").alias("metadata"),
    )
    kept = m.redact_messages(calls, ("team", "tokens"))
    return kept.select("event_id", "input", "output", F.col("metadata")["team"].alias("team_kept"), F.size("metadata").alias("n_entries"))
