"""The query set as plain SQL over the given tables, for a second engine."""

from __future__ import annotations

# Views that several queries build on; a query lists the ones it needs by using their names.
VIEWS = {
    "b_entries": r"""
        select source as case_id, doc_id, concat(source, '.zip') as source_path, lang, text, suffix,
          concat(source, '.zip > ', lang, '/d', cast(doc_id as varchar), suffix) as lineage,
          concat('d', cast(doc_id as varchar), suffix) as original_filename,
          substr(sha1(text), 1, 12) as content_hash,
          case when suffix in ('.pdf', '.docx', '.png', '.pptx') then 'binary'
               when suffix in ('.xlsx', '.eml') then 'text' else 'skipped' end as raw_kind
        from (select *, case doc_id % 8 when 1 then '.docx' when 2 then '.xlsx' when 3 then '.eml' when 4 then '.csv'
                        when 5 then '.png' when 6 then '.pptx' else '.pdf' end as suffix from documents) t""",
    "b_named": r"""
        select *, concat('doc_', substr(sha1(lineage), 1, 16), suffix) as candidate from b_entries""",
    "b_manifest": r"""
        select case_id, doc_id, lang, lineage, original_filename, suffix, content_hash,
          case when raw_kind = 'skipped' then 'skipped' when rn > 1 then 'duplicate' else raw_kind end as kind,
          case when raw_kind <> 'skipped' and rn = 1 then candidate end as staged_name,
          case when raw_kind <> 'skipped' and rn > 1 then first_candidate end as duplicate_of,
          case when raw_kind = 'skipped' then concat('unsupported-ext:', suffix) end as reason
        from (select *, row_number() over w as rn, first_value(candidate) over w as first_candidate from b_named
              window w as (partition by case_id, raw_kind = 'skipped', content_hash order by doc_id)) x""",
    "b_text": r"""
        select case_id, candidate as staged_name, case when suffix = '.png' then '' else text end as text_blocks
        from b_named where raw_kind <> 'skipped'""",
    "b_docs_all": r"""
        select m.case_id, m.doc_id, m.lineage, m.original_filename, m.staged_name, m.content_hash, t.text_blocks
        from b_manifest m join b_text t on m.case_id = t.case_id and m.staged_name = t.staged_name
        where m.kind in ('binary', 'text') and length(t.text_blocks) > 0""",
    "b_docs_failed": r"""
        select m.case_id, m.lineage, m.original_filename, m.staged_name, m.kind, m.content_hash
        from b_manifest m left join b_docs_all d on m.case_id = d.case_id and m.staged_name = d.staged_name
        where m.kind in ('binary', 'text') and d.staged_name is null""",
    "b_taxonomy": r"""
        select label, unnest(string_split(concat(lower(label), ' ', words), ' ')) as keyword, sort_order
        from (values ('en', 'English', 'the and of', 1), ('fr', 'French', 'le la les', 2), ('de', 'German', 'der die und', 3),
          ('es', 'Spanish', 'el los que', 4)) t(lang, label, words, sort_order)
        where lang in (select lang from documents)""",
    "b_scores": r"""
        select d.case_id, d.staged_name, k.label, k.sort_order,
          cast(sum((length(d.t) - length(replace(d.t, concat(' ', k.keyword, ' '), ''))) // (length(k.keyword) + 2)) as bigint) as score
        from (select case_id, staged_name,
                concat(' ', regexp_replace(lower(text_blocks), '[^\p{L}\p{N}]+', '  ', 'g'), ' ') as t from b_docs_all) d
        cross join b_taxonomy k group by d.case_id, d.staged_name, k.label, k.sort_order""",
    "b_classified": r"""
        select d.*, case when s.score > 0 then s.label end as classificacio, s.score,
          case when s.score > 0 then s.score / s.total end as confidence
        from b_docs_all d join (select *, sum(score) over (partition by case_id, staged_name) as total,
            row_number() over (partition by case_id, staged_name order by score desc, sort_order) as rn from b_scores) s
          on d.case_id = s.case_id and d.staged_name = s.staged_name and s.rn = 1""",
    "b_extracted": r"""
        select case_id, staged_name,
          trim(regexp_extract(text_blocks, '\A([^\n]+)', 1)) as titol_document,
          trim(regexp_extract(text_blocks, '([0-9]{4,})', 1)) as numero_expedient,
          trim(regexp_extract(text_blocks, '([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})', 1)) as data_document,
          trim(regexp_extract(text_blocks, '([A-Za-z0-9._]{1,64}@[A-Za-z0-9.]+[a-z])', 1)) as entitat_organisme,
          trim(regexp_extract(text_blocks, '@([A-Za-z0-9.]+[a-z])', 1)) as proveidor_adjudicatari,
          trim(regexp_extract(text_blocks, '([$][0-9A-Za-z]+)', 1)) as import,
          trim(regexp_extract(text_blocks, 'Released under the ([A-Za-z0-9. -]+)', 1)) as tipus_procediment
        from b_docs_all""",
    "b_sentences": r"""
        select case_id, staged_name, list_filter(list_transform(string_split(
            regexp_replace(substr(text_blocks, 1, 6000), '([.!?])[ \n\t]+', concat('\1', chr(10)), 'g'), chr(10)),
            lambda x: trim(x)), lambda x: x <> '') as sents
        from b_docs_all""",
    "b_sentence": r"""
        select case_id, staged_name, unnest(sents) as sentence, generate_subscripts(sents, 1) - 1 as line_no from b_sentences""",
    "b_summaries": r"""
        select s.case_id, s.staged_name, coalesce(r.resum, '') as resum
        from b_sentences s left join (
          select case_id, staged_name, string_agg(sentence, ' ' order by line_no) as resum from (
            select e.*, row_number() over (partition by e.case_id, e.staged_name order by coalesce(c.score, 0) desc, e.line_no) as rn
            from b_sentence e left join (
              select case_id, staged_name, line_no, sum(here * overall) as score from (
                select *, sum(here) over (partition by case_id, staged_name, word) as overall from (
                  select case_id, staged_name, line_no, word, count(*) as here from (
                    select case_id, staged_name, line_no,
                      unnest(list_filter(string_split_regex(lower(sentence), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 4)) as word
                    from b_sentence) w group by case_id, staged_name, line_no, word) h) o
              group by case_id, staged_name, line_no) c
            on e.case_id = c.case_id and e.staged_name = c.staged_name and e.line_no = c.line_no) k
          where rn <= 3 group by case_id, staged_name) r
        on s.case_id = r.case_id and s.staged_name = r.staged_name""",
    "b_result": r"""
        select d.lineage as ruta_del_fitxer, d.original_filename as nom_del_fitxer,
          coalesce(nullif(e.titol_document, ''), d.original_filename) as titol, s.resum, c.classificacio,
          concat_ws(' | ',
            case when e.numero_expedient <> '' then concat('Núm. expedient: ', e.numero_expedient) end,
            case when e.data_document <> '' then concat('Data: ', e.data_document) end,
            case when e.entitat_organisme <> '' then concat('Entitat: ', e.entitat_organisme) end,
            case when e.proveidor_adjudicatari <> '' then concat('Proveïdor/Adjudicatari: ', e.proveidor_adjudicatari) end,
            case when e.import <> '' then concat('Import: ', e.import) end,
            case when e.tipus_procediment <> '' then concat('Tipus procediment: ', e.tipus_procediment) end
          ) as informacio_addicional_proposta,
          e.numero_expedient as num_expedient, e.data_document, e.entitat_organisme, e.proveidor_adjudicatari,
          e.import as import_, e.tipus_procediment
        from b_docs_all d
        join b_classified c on d.case_id = c.case_id and d.staged_name = c.staged_name
        join b_extracted e on d.case_id = e.case_id and d.staged_name = e.staged_name
        join b_summaries s on d.case_id = s.case_id and d.staged_name = s.staged_name""",
    "b_display": r"""
        select ruta_del_fitxer as "Ruta del fitxer", nom_del_fitxer as "Nom del fitxer", titol as "Títol", resum as "Resum",
          classificacio as "Classificació", informacio_addicional_proposta as "Informació addicional (proposta)",
          num_expedient as "Núm. expedient", data_document as "Data document", entitat_organisme as "Entitat / organisme",
          proveidor_adjudicatari as "Proveïdor / adjudicatari", import_ as "Import",
          tipus_procediment as "Tipus de procediment" from b_result""",
    "b_events": r"""
        select event_id, concat(cast(user_id as varchar), '-', cast(cast(ts as date) as varchar)) as case_id,
          concat(cast(user_id as varchar), ':', cast(cast(floor(value) as bigint) % 5 as varchar)) as doc_id, user_id,
          case event_type when 'signup' then 'EXPEDIENT_CREATED' when 'view' then 'FILES_UPLOADED'
            when 'click' then 'FILES_UPLOADED' when 'purchase' then 'DOC_CLASSIFIED' else 'DOC_ERROR' end as type,
          props as payload_json, value, ts
        from events""",
    "b_opened": r"""
        select case_id, concat('user', cast(min(user_id) % 7 as varchar), '@Example.com') as owner,
          case when max(ts) < timestamp '2024-01-05 00:00:00' then 'CLOSED'
               when count(*) filter (where type = 'FILES_UPLOADED') > 0 then 'PROCESSING' else 'DRAFT' end as status,
          min(ts) as created_at, max(ts) as updated_at
        from b_events group by case_id""",
    "b_event_documents": r"""
        select cast(event_id as varchar) as doc_id, case_id,
          case when type = 'DOC_ERROR' then 'ERROR' else 'CLASSIFIED' end as status
        from b_events where type in ('DOC_CLASSIFIED', 'DOC_ERROR')""",
    "b_cases": r"""
        select o.case_id, o.owner, o.created_at,
          case when c.case_id is null then o.updated_at else timestamp '2024-02-01 00:00:00' end as updated_at,
          coalesce(c.n, 0) as docs_total, coalesce(c.good, 0) as docs_classified, coalesce(c.bad, 0) as docs_error,
          case when o.status = 'CLOSED' or c.case_id is null then o.status
               when c.bad > 0 then 'NEEDS_REVIEW' else 'READY' end as status
        from b_opened o left join (select case_id, count(*) as n, count(*) filter (where status = 'CLASSIFIED') as good,
            count(*) filter (where status = 'ERROR') as bad from b_event_documents group by case_id) c
          on o.case_id = c.case_id""",
    "b_log": r"""
        select event_id, doc_id, type as classificacio, ts as created_at,
          cast(row_number() over w as bigint) as version, lead(ts) over w as archived_at
        from b_events window w as (partition by doc_id order by ts, event_id)""",
    "b_uploads": r"""
        select case_id, concat('_in_', cast(event_id as varchar), '.pdf') as filename, cast(floor(value) as bigint) as bytes,
          concat('u', cast(user_id as varchar)) as owner from b_events where type = 'FILES_UPLOADED'
        union all
        select cast(user_id as varchar), null, cast(floor(value) as bigint), concat('u', cast(user_id as varchar))
        from b_events where type = 'FILES_UPLOADED'""",
    "b_judged": r"""
        select u.case_id, u.filename, u.bytes, u.owner,
          case when u.filename is null then 'no-name' when u.bytes <= 0 then 'empty' when c.status is null then 'unknown-case'
               when c.status = 'CLOSED' then 'closed' else 'accepted' end as outcome
        from b_uploads u left join b_cases c on u.case_id = c.case_id""",
    "b_requests": r"""
        select case_id, title, owner from (
          select *, row_number() over (partition by case_id order by owner, title) as rn from (
            select case_id, 'again' as title, owner from b_opened
            union all select distinct source, lang, concat(lang, '@example.com') from documents
            union all select c_name, null, 'crm' from customer) r) x where rn = 1""",
    "b_request_outcome": r"""
        select r.*, case when not regexp_matches(r.case_id, '^[A-Za-z0-9][A-Za-z0-9_-]{0,62}\z') then 'invalid'
                         when c.case_id is not null then 'exists' else 'created' end as outcome
        from b_requests r left join b_cases c on r.case_id = c.case_id""",
    "b_state_documents": r"""
        select concat(case_id, ':', staged_name) as doc_id, case_id, staged_name, original_filename, lineage as original_lineage,
          'CLASSIFIED' as status, cast(null as varchar) as error_message, cast(null as varchar) as staged_kind from b_docs_all
        union all
        select concat(case_id, ':', staged_name), case_id, staged_name, original_filename, lineage, 'ERROR',
          'El document no s''ha pogut llegir (format no suportat, corrupte o buit).', kind from b_docs_failed""",
    "b_state_classifications": r"""
        select concat(c.case_id, ':', c.staged_name) as doc_id, c.case_id, c.classificacio, c.confidence,
          coalesce(nullif(e.titol_document, ''), c.original_filename) as titol, nullif(e.entitat_organisme, '') as entitat_organisme
        from b_classified c join b_extracted e on c.case_id = e.case_id and c.staged_name = e.staged_name""",
    "b_first_manifest": r"""
        select * from (
          select case_id, doc_id, lineage, raw_kind, candidate, suffix,
            row_number() over w as rn, first_value(candidate) over w as first_candidate
          from b_named where lang in ('en', 'fr')
          window w as (partition by case_id, raw_kind = 'skipped', content_hash order by doc_id)) x""",
    "b_first_items": r"""
        select case_id, doc_id, lineage, suffix,
          case when raw_kind = 'skipped' then 'skipped' when rn > 1 then 'duplicate' else raw_kind end as kind,
          case when raw_kind <> 'skipped' and rn = 1 then candidate end as staged_name,
          case when raw_kind <> 'skipped' and rn > 1 then first_candidate end as duplicate_of from b_first_manifest""",
}

_OPENED = r"""
select case_id, lineage, original_filename, suffix, content_hash,
  case when reason is not null then 'skipped' when rn > 1 then 'duplicate' else raw_kind end as kind,
  case when reason is null and rn = 1 then candidate end as staged_name,
  case when reason is null and rn > 1 then first_candidate end as duplicate_of, reason, text_md5
from (select *, row_number() over w as rn, first_value(candidate) over w as first_candidate from (
  select *, concat('doc_', substr(sha1(lineage), 1, 16), suffix) as candidate from (
    select source as case_id, concat('d', cast(doc_id as varchar), '.zip') as source_path, p as pos,
      concat('d', cast(doc_id as varchar), '.zip > ', case p when 0 then concat('texts/d', cast(doc_id as varchar), '.pdf')
        when 1 then 'inner.zip > copy.pdf' when 2 then 'inner.zip > notes.txt' when 3 then 'mail.eml (cuerpo)'
        else 'sheet.xlsx' end) as lineage,
      case p when 0 then concat('d', cast(doc_id as varchar), '.pdf') when 1 then 'copy.pdf' when 2 then 'notes.txt'
        when 3 then 'mail.eml (cuerpo)' else 'sheet.xlsx' end as original_filename,
      case p when 0 then '.pdf' when 1 then '.pdf' when 2 then '.txt' when 3 then '.txt' else '.xlsx' end as suffix,
      case when p < 2 then substr(sha1(text), 1, 12) when p = 3 then substr(sha1(body), 1, 12) end as content_hash,
      case p when 0 then text when 1 then text when 3 then body when 4 then concat('xlsx', sheet) else '' end as same,
      case when p < 2 then 'binary' else 'text' end as raw_kind,
      case when p = 2 then 'unsupported-ext:.txt' end as reason,
      case p when 3 then md5(body) when 4 then md5(sheet) end as text_md5
    from (select *, concat('Asunto: ', lang, chr(10), 'De: sender@example.com', chr(10), 'Fecha: ', chr(10), chr(10),
              text, case when text like concat('%', chr(10)) then '' else chr(10) end) as body,
            array_to_string(list_concat([concat('### Hoja: ', lang), concat(cast(length(text) as varchar), ' | ',
                strftime(timestamp '1899-12-30 00:00:00' + to_days(cast(45292 + length(text) % 1000 as integer)), '%Y-%m-%d %H:%M:%S'), ' | True')],
              list_filter(string_split(text, chr(10)), lambda x: x <> '')), chr(10)) as sheet
          from documents) d cross join (values (0), (1), (2), (3), (4)) parts(p)) leaf) named
  window w as (partition by case_id, reason is not null, same order by source_path, pos)) x"""

_STREAMED = r"""
select case_id, lineage, original_filename, suffix, content_hash,
  case when reason is not null then 'skipped' when rn > 1 then 'duplicate' else raw_kind end as kind,
  case when reason is null and rn = 1 then candidate end as staged_name,
  case when reason is null and rn > 1 then first_candidate end as duplicate_of, reason,
  concat('/archive/', case_id, '/', source_path) as archive_path, batch_id
from (select *, row_number() over w as rn, first_value(candidate) over w as first_candidate from (
  select *, concat('doc_', substr(sha1(lineage), 1, 16), suffix) as candidate from (
    select concat('case', cast(n % 7 as varchar)) as case_id, source_path, doc_id, inner_at,
      cast(n // archives as bigint) as batch_id,
      concat(source_path, ' > ', member, case inner_at when 1 then ' > copy.pdf' when 2 then ' > notes.txt'
        when 3 then ' (cuerpo)' else '' end) as lineage,
      case inner_at when 1 then 'copy.pdf' when 2 then 'notes.txt' else concat('d', cast(doc_id as varchar), own,
        case inner_at when 3 then ' (cuerpo)' else '' end) end as original_filename,
      case inner_at when 1 then '.pdf' when 2 then '.txt' when 3 then '.txt' else own end as suffix,
      case when inner_at = 3 then 'text' else 'binary' end as raw_kind,
      case when own = '.csv' then 'unsupported-ext:.csv' when inner_at = 2 then 'unsupported-ext:.txt'
        when doc_id % 8 = 7 then 'bad-zip' end as reason,
      case when own = '.csv' or inner_at = 2 or doc_id % 8 = 7 then null
        else substr(sha1(case when inner_at = 3 then body else text end), 1, 12) end as content_hash
    from (select *, concat('a', lpad(cast(n as varchar), 5, '0'), '.zip') as source_path,
            concat(lang, '/d', cast(doc_id as varchar), own) as member,
            concat('Asunto: ', lang, chr(10), 'De: sender@example.com', chr(10), 'Fecha: ', chr(10), chr(10),
              text, case when text like concat('%', chr(10)) then '' else chr(10) end) as body,
            unnest(case own when '.zip' then case doc_id % 8 when 2 then [1, 2] else [0] end when '.eml' then [3] else [0] end) as inner_at
          from (select *, doc_id % (archives * 5) as n, case doc_id % 8 when 1 then '.docx' when 2 then '.zip' when 3 then '.jpg'
                  when 4 then '.csv' when 5 then '.eml' when 7 then '.zip' else '.pdf' end as own
                from documents, (select greatest(1, count(*) // 250) as archives from documents) a) d) m) leaf) named
  window w as (partition by case_id, reason is not null, content_hash order by batch_id, source_path, doc_id, inner_at)) x"""

_MANIFEST = "case_id, lineage, original_filename, suffix, content_hash, kind, staged_name, duplicate_of, reason"

SQL = {
    "manifest_by_case": f"select {_MANIFEST} from b_manifest",
    "manifest_global": r"""
        select case_id, lineage, original_filename, suffix, content_hash,
          case when raw_kind = 'skipped' then 'skipped' when rn > 1 then 'duplicate' else raw_kind end as kind,
          case when raw_kind <> 'skipped' and rn = 1 then candidate end as staged_name,
          case when raw_kind <> 'skipped' and rn > 1 then first_candidate end as duplicate_of,
          case when raw_kind = 'skipped' then concat('unsupported-ext:', suffix) end as reason
        from (select *, row_number() over w as rn, first_value(candidate) over w as first_candidate from b_named
              window w as (partition by raw_kind = 'skipped', content_hash order by case_id, doc_id)) x""",
    "manifest_kind_counts": """
        select kind, count(*) as n, count(distinct case_id) as source_files from b_manifest group by kind""",
    "manifest_merge": """
        select case_id, lineage, kind, staged_name, duplicate_of from b_first_items
        union all
        select n.case_id, n.lineage, n.kind, n.staged_name, n.duplicate_of from b_manifest n
        where not exists (select 1 from b_first_items o where o.case_id = n.case_id
          and ((n.staged_name is not null and o.staged_name = n.staged_name)
            or (n.staged_name is null and o.staged_name is null and o.kind = n.kind and o.lineage = n.lineage)))""",
    "manifest_rows": """
        select case_id, lineage, kind, staged_name,
          case when kind in ('binary', 'text') then original_filename end as original_filename,
          duplicate_of, reason from b_manifest""",
    "path_parts": r"""
        select doc_id, suffix, original_filename as leaf, original_filename as name, case_id as path_case,
          '_unassigned' as stray_case, concat(lang, '/', lineage) as relative_name, original_filename as stray_name,
          concat('/landing/', case_id, '/raw/', lang, '/', lineage) as bare, concat('/inbox/', lineage) as stray_bare
        from b_entries""",
    "expand_containers": _OPENED,
    "stream_ingest": _STREAMED,
    "read_manifest_json": """
        select case_id, lineage, kind, staged_name,
          case when kind in ('binary', 'text') then original_filename end as original_filename,
          duplicate_of, reason from b_manifest""",
    "read_whole_text": """
        select case_id, staged_name, md5(concat(text_blocks, chr(10))) as text_md5 from b_docs_all""",
    "read_binary": """
        select case_id, candidate as staged_name, cast(strlen(text) as bigint) as length, sha1(text) as data_sha1
        from b_named where raw_kind = 'binary'""",
    "parse_office": """
        select doc_id, source as case_id, case doc_id % 3 when 0 then '.docx' when 1 then '.pptx' else '.pdf' end as suffix,
          case when doc_id % 3 <> 2 and doc_id % 7 = 0 then '' else text end as text_blocks,
          case when doc_id % 3 <> 2 and doc_id % 7 = 0 then 'unreadable:BadZipFile' end as parse_error from documents""",
    "parse_variant": "select doc_id, text as text_blocks, cast(null as varchar) as error_status from documents",
    "page_titles": "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages",
    "docs_all": "select case_id, lineage, original_filename, staged_name, content_hash, text_blocks from b_docs_all",
    "docs_union": "select case_id, staged_name, cast(length(text_blocks) as bigint) as chars from b_docs_all",
    "docs_failed": "select *, cast(null as varchar) as reason from b_docs_failed",
    "docs_failed_with_skipped": """
        select *, cast(null as varchar) as reason from b_docs_failed union all
        select case_id, lineage, original_filename, staged_name, kind, content_hash, reason from b_manifest where kind = 'skipped'""",
    "prompt_inputs": "select case_id, staged_name, substr(text_blocks, 1, 6000) as prompt_text from b_docs_all",
    "summaries": "select * from b_summaries",
    "summaries_lead": """
        select case_id, staged_name, coalesce(array_to_string(list_slice(sents, 1, 3), ' '), '') as resum from b_sentences""",
    "classified": """
        select case_id, staged_name, classificacio, score, confidence, 'ai_functions' as model, 'v2.0' as prompt_version,
          'AUTO' as source from b_classified""",
    "extracted_fields": """
        select case_id, staged_name, titol_document, nullif(numero_expedient, '') as num_expedient,
          nullif(data_document, '') as data_document, nullif(entitat_organisme, '') as entitat_organisme,
          nullif(proveidor_adjudicatari, '') as proveidor_adjudicatari, nullif(import, '') as import_,
          nullif(tipus_procediment, '') as tipus_procediment from b_extracted""",
    "incremental_todo": """
        select case_id, staged_name from b_classified where classificacio is null or classificacio <> 'English'""",
    "resultat_final": "select * from b_result",
    "report_export": "select * from b_display",
    "report_widths": " union all ".join(
        f"""select '{h}' as col, cast(least(greatest(coalesce(max(length("{h}")), 0), {len(h)}) + 2, 60) as bigint) as width from b_display"""
        for h in (
            "Ruta del fitxer", "Nom del fitxer", "Títol", "Resum", "Classificació", "Informació addicional (proposta)",
            "Núm. expedient", "Data document", "Entitat / organisme", "Proveïdor / adjudicatari", "Import", "Tipus de procediment",
        )
    ),
    "scalar_rules": r"""
        select case_id, lineage, concat(case_id, ':', content_hash) as doc_id,
          case suffix when '.pdf' then 'application/pdf' when '.png' then 'image/png' when '.csv' then 'text/csv'
            when '.docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
            else 'application/octet-stream' end as content_type,
          kind <> 'skipped' and suffix in ('.pdf', '.png') as previewable,
          coalesce(duplicate_of, original_filename) as tree_label, original_filename as card_label,
          replace(lineage, '/', '_') as safe_name, true as valid_case, false as valid_lineage,
          concat('{"filename":"', original_filename, '","kind":"', kind, '"}') as payload
        from b_manifest""",
    "case_rollup": "select case_id, owner, status, docs_total, docs_classified, docs_error from b_cases",
    "classification_log": "select * from b_log",
    "classification_latest": "select doc_id, event_id, classificacio, created_at from b_log where archived_at is null",
    "classification_history": "select doc_id, classificacio, version, archived_at from b_log where archived_at is not null",
    "classifications_replace": """
        select concat(case_id, ':', staged_name) as doc_id, classificacio, 'ai_functions' as model, 'v2.0' as prompt_version,
          'current' as part from b_classified
        union all
        select concat(case_id, ':', staged_name), classificacio, 'first', 'v1.0', 'history' from b_classified
        where classificacio in ('English', 'French')""",
    "documents_upsert": """
        select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.case_id, o.case_id) as case_id,
          coalesce(n.staged_name, o.staged_name) as staged_name, coalesce(n.status, o.status) as status,
          case when n.doc_id is not null then n.error_message else o.error_message end as error_message,
          o.doc_id is not null as known_before, n.doc_id is not null as updated
        from b_state_documents n full join (
          select concat(case_id, ':', staged_name) as doc_id, case_id, staged_name,
            case when suffix = '.pdf' then 'ERROR' else 'CLASSIFIED' end as status,
            case when suffix = '.pdf' then 'El document no s''ha pogut llegir (format no suportat, corrupte o buit).' end as error_message
          from b_first_items where staged_name is not null
          union all
          select concat('bench:item', cast(item_id as varchar)), 'bench', concat('item', cast(item_id as varchar)), 'CLASSIFIED', null
          from benchmark) o on n.doc_id = o.doc_id""",
    "cases_upsert": """
        select coalesce(c.case_id, t.case_id) as case_id, coalesce(c.owner, 'pipeline') as owner,
          case when c.status = 'CLOSED' or t.case_id is null then c.status else 'PROCESSING' end as status,
          coalesce(c.docs_total, 0) as docs_total,
          case when t.case_id is null then c.updated_at else timestamp '2024-02-01 00:00:00' end as updated_at
        from b_cases c full join (select case_id from b_events where type = 'FILES_UPLOADED'
          union select source from documents) t on c.case_id = t.case_id""",
    "create_cases": "select case_id, title, owner, outcome from b_request_outcome",
    "create_cases_events": """
        select case_id, owner as "user", 'EXPEDIENT_CREATED' as type, '{}' as payload_json, 'DRAFT' as status,
          cast(0 as bigint) as docs_total from b_request_outcome where outcome = 'created'""",
    "register_uploads": "select case_id, filename, bytes, owner, outcome from b_judged",
    "register_uploads_cases": """
        select c.case_id, case when u.case_id is null then c.status else 'PROCESSING' end as status,
          case when u.case_id is null then c.updated_at else timestamp '2024-02-01 00:00:00' end as updated_at,
          u.told, u.first_payload
        from b_cases c left join (select case_id, count(*) as told,
            min(concat('{"filename":"', filename, '","bytes":', cast(bytes as varchar), '}')) as first_payload
          from b_judged where outcome = 'accepted' group by case_id) u on c.case_id = u.case_id""",
    "delete_cases": """
        select case_id, 'case' as part, count(*) as n from b_cases where status <> 'CLOSED' group by case_id
        union all select d.case_id, 'document', count(*) from b_event_documents d join b_cases c on d.case_id = c.case_id
          where c.status <> 'CLOSED' group by d.case_id
        union all select d.case_id, 'classification', count(*) from b_event_documents d join b_cases c on d.case_id = c.case_id
          where c.status <> 'CLOSED' and d.status = 'CLASSIFIED' group by d.case_id""",
    "remember_run": """
        select case_id, max(event_id) as last_run_id, timestamp '2024-02-01 00:00:00' as updated_at from b_events group by case_id""",
    "taxonomy_active": """
        select lang as label, case when seeded then concat('texts in ', lang) else 'known' end as description,
          cast(case when seeded then n else -n end as integer) as sort_order, true as active
        from (select lang, count(*) as n, max(n_chars) >= 10000 and lang <> 'fr' as seeded from documents group by lang) x
        where seeded or lang > 'en'""",
    "event_log": """
        select case_id, concat(case_id, ':', staged_name) as doc_id, 'pipeline' as "user", 'DOC_CLASSIFIED' as type,
          concat('{"classificacio":', case when classificacio is null then 'null' else concat('"', classificacio, '"') end, '}') as payload_json
        from b_classified
        union all
        select case_id, concat(case_id, ':', staged_name), 'pipeline', 'DOC_ERROR',
          concat('{"original_filename":"', original_filename, '"}') from b_docs_failed""",
    "constraint_violations": """
        select 'unique' as rule, 'entries' as "table", concat(case_id, ':', content_hash) as key, count(*) as n
        from b_entries group by case_id, content_hash having count(*) > 1
        union all select 'enum', 'manifest', kind, count(*) from b_manifest where kind not in ('binary', 'text') group by kind
        union all select 'not null', 'manifest', 'staged_name', count(*) from b_manifest where staged_name is null having count(*) > 0
        union all select 'not null', 'manifest', 'duplicate_of', count(*) from b_manifest where duplicate_of is null having count(*) > 0
        union all select 'foreign key', 'documents', cast(d.doc_id as varchar), count(*) from documents d
          left join labels l on d.doc_id = l.doc_id where l.doc_id is null group by d.doc_id""",
    "case_list": """
        select case_id, owner, status, updated_at from b_cases
        where lower(owner) = 'user3@example.com' and status = 'NEEDS_REVIEW' order by updated_at desc, case_id limit 500""",
    "case_list_reviewer": """
        select case_id, owner, status, updated_at from b_opened order by updated_at desc, case_id limit 500""",
    "case_facets": """
        select case_id, status, docs_error from b_cases where status in ('READY', 'NEEDS_REVIEW')
          and created_at >= timestamp '2024-01-24 00:00:00' and docs_error > 0 and contains(lower(case_id), '1-2024')""",
    "facet_counts": """
        select c.status, count(*) as n, f.position from b_cases c join (values ('DRAFT', 1), ('PROCESSING', 2), ('READY', 3),
          ('NEEDS_REVIEW', 4), ('CLOSED', 5)) f(status, position) on c.status = f.status group by c.status, f.position""",
    "case_detail": """
        select 'pipeline' as owner, 'PROCESSING' as case_status,
          d.doc_id, d.original_filename, d.original_lineage, d.status, d.error_message, c.titol, c.classificacio,
          c.confidence, c.entitat_organisme
        from b_state_documents d left join b_state_classifications c on d.doc_id = c.doc_id where d.case_id = 'src3'""",
    "case_documents": """
        select d.doc_id, d.case_id, d.status, c.titol, c.classificacio
        from b_state_documents d left join b_state_classifications c on d.doc_id = c.doc_id""",
    "document_history": """
        select event_id as history_id, classificacio, 'AUTO' as source, archived_at from b_log
        where doc_id = '7:3' and archived_at is not null""",
    "stats_totals": """
        select (select count(*) from b_opened) as expedients,
          (select count(*) from b_manifest where staged_name is not null) as documents,
          (select count(*) from b_docs_failed) as errors""",
    "stats_totals_scoped": """
        select (select count(*) from b_cases where lower(owner) = 'user3@example.com') as expedients,
          count(*) as documents, count(*) filter (d.status = 'ERROR') as errors
        from b_event_documents d join b_cases c on d.case_id = c.case_id where lower(c.owner) = 'user3@example.com'""",
    "stats_by_category": """
        select classificacio as label, count(*) as n from b_classified where classificacio is not null group by classificacio""",
    "case_lifecycle": """
        select c.case_id, s.position, s.step,
          case s.step when 'draft' then 'Esborrany' when 'processing' then 'Processant'
            else case c.status when 'READY' then 'A punt' when 'NEEDS_REVIEW' then 'Cal revisió' when 'CLOSED' then 'Tancat'
              else 'Resultats' end end as label,
          case s.step when 'draft' then case when c.status = 'DRAFT' then 'current' else 'done' end
            when 'processing' then case c.status when 'DRAFT' then 'pending' when 'PROCESSING' then 'running' else 'done' end
            else case when c.status = 'NEEDS_REVIEW' then 'error' when c.status in ('READY', 'CLOSED') then 'done' else 'pending' end
          end as state
        from b_cases c cross join (values (0, 'draft'), (1, 'processing'), (2, 'result')) s(position, step)""",
    "task_steps": """
        select c.case_id, t.task_key,
          case when c.status = 'CLOSED' then 'done' when c.status = 'DRAFT' then 'pending'
               when (case when r.user_id % 2 = 0 then 'autoloader_ingest' else 'classify_merge' end) <> t.task_key then 'pending'
               else case r.type when 'EXPEDIENT_CREATED' then 'pending' when 'FILES_UPLOADED' then 'running'
                 when 'DOC_CLASSIFIED' then 'done' else 'error' end end as state
        from b_opened c
        join (select case_id, max(event_id) as run_id from b_events group by case_id) l on c.case_id = l.case_id
        join b_events r on r.event_id = l.run_id
        cross join (values ('autoloader_ingest'), ('classify_merge')) t(task_key)""",
    "stats_by_category_scoped": """
        select classificacio as label, cast(count(*) as bigint) as n from b_classified
        where classificacio is not null and case_id = 'src1' group by classificacio""",
    "case_progress": """
        select c.case_id, c.status, docs_total, docs_error,
          concat('draft=', case when c.status = 'DRAFT' then 'current' else 'done' end,
            ',processing=', case c.status when 'DRAFT' then 'pending' when 'PROCESSING' then 'running' else 'done' end,
            ',result=', case when c.status = 'NEEDS_REVIEW' then 'error' when c.status in ('READY', 'CLOSED') then 'done' else 'pending' end) as lifecycle,
          concat('ingest=', case when c.status = 'DRAFT' then 'pending' when c.status <> 'PROCESSING' then 'done'
                when r.user_id % 2 = 0 then r.state else 'pending' end,
            ',classify=', case when c.status = 'DRAFT' then 'pending' when c.status <> 'PROCESSING' then 'done'
                when r.user_id % 2 = 1 then r.state else 'pending' end) as tasks
        from (select * replace (case when docs_total % 2 = 0 and status = 'READY' then 'PROCESSING' else status end as status) from b_cases) c
        join (select case_id, max(event_id) as run_id from b_events group by case_id) l on c.case_id = l.case_id
        join (select event_id, user_id, case type when 'EXPEDIENT_CREATED' then 'pending' when 'FILES_UPLOADED' then 'running'
            when 'DOC_CLASSIFIED' then 'done' else 'error' end as state from b_events) r on r.event_id = l.run_id""",
    "document_files": """
        select concat(m.case_id, ':', m.staged_name) as doc_id, m.case_id, m.original_filename, m.kind,
          concat('staging/', m.case_id, '/', m.kind, '/', m.staged_name) as path,
          case m.suffix when '.pdf' then 'application/pdf' when '.png' then 'image/png'
            when '.docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
            else 'application/octet-stream' end as content_type,
          m.suffix = '.pdf' as previewable
        from b_manifest m where m.staged_name is not null""",
}


def _needed(text: str) -> list[str]:
    """Views a text uses, directly or through others, in definition order."""
    wanted, todo = set(), [text]
    while todo:
        t = todo.pop()
        for name, body in VIEWS.items():
            if name not in wanted and name in t:
                wanted.add(name)
                todo.append(body)
    return [name for name in VIEWS if name in wanted]


def statement(name: str) -> str:
    """One self-contained statement for a query."""
    views = ",\n".join(f"{v} as ({VIEWS[v]})" for v in _needed(SQL[name]))
    return f"with {views}\n{SQL[name]}" if views else SQL[name]


def oracle_sql() -> dict[str, str]:
    return {name: statement(name) for name in SQL}
