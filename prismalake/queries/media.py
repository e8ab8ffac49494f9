"""Scan, sync, text and tokenizer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import tokenizers as tk
from ..operators import ingest
from ..sources import media as md
from . import register

PS = "photos live_media"
register("sync_urls_to_delete", lambda g: ingest.paths_to_delete(g.photos, g.live), "SELECT file_path FROM photos WHERE file_path NOT IN (SELECT file_path FROM live_media)", PS)
register("sync_photos_to_upsert", lambda g: ingest.photos_to_upsert(g.live, g.photos), "SELECT l.* FROM live_media l LEFT JOIN photos p ON p.file_path = l.file_path WHERE p.id IS NULL OR l.id <> p.id OR l.file_size <> p.file_size OR l.file_last_modified <> p.file_last_modified", PS)
register("sync_modified_ids", lambda g: ingest.modified_ids(g.live, g.photos), "SELECT p.id FROM live_media l JOIN photos p ON p.file_path = l.file_path WHERE l.file_size <> p.file_size OR l.file_last_modified <> p.file_last_modified", PS)
register("sync_status", lambda g: ingest.sync_status(g.live, g.photos), "SELECT l.file_path, CASE WHEN p.id IS NULL THEN 'new' WHEN l.id <> p.id OR l.file_size <> p.file_size OR l.file_last_modified <> p.file_last_modified THEN 'modified' ELSE 'same' END AS status FROM live_media l LEFT JOIN photos p ON p.file_path = l.file_path", PS)


def listing(g):
    return g.photos.select("id", "file_path", "file_name", F.concat("relative_path", F.lit("/")).alias("relative_path"), (F.col("file_last_modified") / 1000).cast("long").alias("modified_s"), F.col("date_taken").alias("taken_ms"), F.floor(F.col("date_added") / 1000).alias("added_s"), F.col("is_favorite").cast("int").alias("favorite"), (F.coalesce("width", F.lit(0))).alias("width"), F.coalesce("height", F.lit(-1)).alias("height"), "orientation", F.col("file_size").alias("size_bytes"), F.col("mime_type").alias("mime"))


register("scan_media_incremental", lambda g: md.scan_incremental(listing(g), ["DCIM/src1", "DCIM/src2"], 1700000100000).select("id", "modified_s"), "SELECT id, file_last_modified // 1000 AS modified_s FROM photos WHERE file_last_modified // 1000 > 1700000100 AND relative_path IN ('DCIM/src1', 'DCIM/src2')")
register("scan_live_uris", lambda g: md.live_paths(listing(g), ["DCIM/src1"]), "SELECT file_path FROM photos WHERE relative_path = 'DCIM/src1'")
register("photo_row_projection", lambda g: md.photo_row(listing(g)).select("id", "folder_path", "relative_path", "date_taken", "file_last_modified", "is_favorite", "width", "height", "orientation", "file_size", "mime_type", "media_type"), """SELECT id, coalesce(relative_path, '') AS folder_path, relative_path, CASE WHEN date_taken > 0 THEN date_taken ELSE file_last_modified END AS date_taken, file_last_modified, is_favorite, width, height, orientation, file_size, mime_type,
    CASE WHEN width IS NULL OR height IS NULL THEN 0 WHEN greatest(width / height, height / width) > 2.2 THEN 3 WHEN width = height THEN 8 ELSE 1 END AS media_type FROM photos""")
register(
    "extract_relative_path",
    lambda g: g.photos.select("id", md.extract_relative_path(F.concat(F.lit("/storage/0/"), F.coalesce("relative_path", F.lit("Other/x")), F.lit("/"), "file_name")).alias("p")),
    "SELECT id, relative_path AS p FROM photos",
)
register("detect_media_type", lambda g: g.photos.select("id", tx.detect_media_type(F.when(F.col("id") % 20 == 0, F.lit("Screenshot_1.png")).when(F.col("id") % 21 == 0, F.lit("BURST_2.jpg")).otherwise(F.col("file_name")), F.when(F.col("id") % 22 == 0, F.lit("Pictures/WhatsApp")).when(F.col("id") % 25 == 0, F.lit("Docs/Scans")).otherwise(F.col("relative_path")), F.col("width"), F.col("height"), F.col("camera_make"), F.col("camera_model")).alias("t")),
    """WITH r AS (SELECT *, CAST(width AS FLOAT) / CAST(height AS FLOAT) AS q FROM photos)
    SELECT id, CAST(CASE WHEN id % 20 = 0 THEN 5 WHEN id % 22 <> 0 AND id % 25 = 0 THEN 6 WHEN id % 22 = 0 THEN 7 WHEN id % 21 = 0 THEN 4
      WHEN width > 0 AND height > 0 THEN CASE WHEN greatest(q, CAST(1 AS FLOAT) / q) > CAST(2.2 AS FLOAT) THEN 3 WHEN q = 1 THEN 8 WHEN lower(coalesce(camera_model, '')) LIKE '%front%' THEN 2 ELSE 1 END
      WHEN camera_make IS NULL AND camera_model IS NULL THEN 0 ELSE 1 END AS INT) AS t FROM r""",
)
register("media_type_label", lambda g: g.photos.select("id", tx.media_type_label(F.col("media_type")).alias("label")), "SELECT id, ['Other', 'Photo', 'Selfie', 'Panorama', 'Burst', 'Screenshot', 'Document', 'Social', 'Square'][media_type + 1] AS label FROM photos")
register("sanitize_name", lambda g: g.cities.select("id", tx.sanitize_name(F.col("name")).alias("s")), "SELECT id, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS s FROM cities", "cities")
register("folder_display_name", lambda g: g.photos.filter("relative_path is not null").select("id", tx.folder_display_name(F.col("relative_path")).alias("s")), "SELECT id, split_part(relative_path, '/', -1) AS s FROM photos WHERE relative_path IS NOT NULL")
register("format_file_size", lambda g: g.photos.select("id", tx.format_file_size(F.col("file_size")).alias("s")), "SELECT id, CASE WHEN file_size <= 0 THEN '0 B' WHEN file_size < 1024 THEN printf('%.1f B', CAST(file_size AS DOUBLE)) WHEN file_size < 1048576 THEN printf('%.1f KB', round(file_size / 1024.0, 1)) ELSE printf('%.1f MB', round(file_size / 1048576.0, 1)) END AS s FROM photos")
register("format_number", lambda g: g.photos.select("id", tx.format_number(F.col("file_size")).alias("s")), "SELECT id, format('{:,}', file_size) AS s FROM photos")
register("normalize_text", lambda g: g.photos.join(g.spark.read.parquet(f"{g.dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text"), "id").select("id", tx.normalize_column()("text").alias("s")), "SELECT doc_id AS id, replace(replace(strip_accents(lower(text)), 'œ', 'oe'), 'æ', 'ae') AS s FROM documents")
register("format_person_name", lambda g: g.persons.select("id", tx.format_person_name(F.concat(F.lit("  jean-PAUL  "), F.coalesce("name", F.lit("x")))).alias("s")), "SELECT id, 'Jean-PAUL ' || CASE WHEN name IS NULL THEN 'X' ELSE name END AS s FROM persons", "persons")
register("name_autocomplete", lambda g: g.persons.filter(tx.normalize_column()("name").contains(tx.normalize_text("SÓN 4"))).select("id"), "SELECT id FROM persons WHERE lower(name) LIKE '%son 4%'", "persons")
LETTERS = "▁abcdefghijklmnopqrstuvwxyz0123456789_.:/"
TOY = tk.Unigram([("<unk>", 0.0), *((c, -2.0) for c in LETTERS), ("▁IMG", -3.0), ("content", -4.0), ("12", -3.5), ("1", -9.0)])
ids_of = lambda tokenizer, c, n=None: F.array_join(F.slice(tk.encode_column(tokenizer)(c), 1, n or 10_000).cast("array<string>"), " ")


def spelled(text: str, letters: str, first: int) -> str:
    """SQL: ids of the letters of a text, numbered from ``first``, joined by spaces."""
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: instr('{letters}', c) + {first - 1}), ' ')"


# a word costs less than its letters, "12" less than "1" and "2"; pieces are numbered as listed
register(
    "unigram_encode", lambda g: g.photos.select("id", ids_of(TOY, "file_path").alias("ids")),
    f"""WITH t AS (SELECT id, regexp_extract_all(CAST(id AS VARCHAR), '12|[0-9]') AS d FROM photos)
        SELECT id, '1 ' || {len(LETTERS) + 2} || ' ' || {spelled("'://'", LETTERS, 1)} || ' ' || array_to_string(list_transform(d, lambda x: CASE WHEN x = '12' THEN {len(LETTERS) + 3} ELSE instr('{LETTERS}', x) END), ' ') AS ids FROM t""",
)
BPE = tk.SentencePieceBpe({c: k for k, c in enumerate(["<pad>", "<eos>", "<unk>", *(f"<0x{b:02X}>" for b in range(256)), "IMG", "IM", "G"])}, tk.parse_merges(["I M", "IM G"]), 24)
# IMG is merged in two steps, everything else falls back to its bytes; then the end mark and padding to 24
register(
    "sentencepiece_bpe_encode", lambda g: g.photos.select("id", ids_of(BPE, "file_name").alias("ids")),
    """WITH t AS (SELECT id, list_concat([259], list_transform(string_split(substr(file_name, 4), ''), lambda c: ascii(c) + 3), [1]) AS t FROM photos)
       SELECT id, array_to_string(list_concat(t, list_transform(range(0, 24 - len(t)), lambda x: 0)), ' ') AS ids FROM t""",
)
CLIP = tk.ClipBpe({c: k for k, c in enumerate(["<|startoftext|>", "<|endoftext|>", *(a + e for a in tk.byte_alphabet().values() for e in ("", "</w>"))])}, {})
# letters, single digits and signs are words; a word's last letter is the one with an end mark; zeros up to 77
register(
    "clip_bpe_encode", lambda g: g.photos.select("id", ids_of(CLIP, "file_name").alias("ids")),
    """WITH w AS (SELECT id, regexp_extract_all(lower(file_name), '[a-z]+|[0-9]|[_.]+') AS w FROM photos),
       t AS (SELECT id, list_concat([0], flatten(list_transform(w, lambda x: list_transform(range(1, len(x) + 1), lambda i: 2 + 2 * (ascii(x[i]) - 33) + CASE WHEN i = len(x) THEN 1 ELSE 0 END))), [1]) AS t FROM w)
       SELECT id, array_to_string(list_concat(t, list_transform(range(0, 77 - len(t)), lambda x: 0)), ' ') AS ids FROM t""",
)
