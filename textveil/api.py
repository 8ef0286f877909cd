"""The library's functions in one place.

    from textveil import api
    found = api.detect(docs, dictionary=[("Acme", "ORG")])      # findings per text
    masked = api.mask(found)                                    # placeholders per text
    maps = api.gather(api.mapping_rows(masked, ["doc_id"]), ["doc_id"])
    back = api.restore(replies, maps, ["doc_id"])
"""

from textveil.operators.adapters import prompted, token_windowed
from textveil.operators.chunking import char_chunks, place, token_chunks
from textveil.operators.detect import detect, exploded, high_risk_only, toggle, unmasked_high_risk
from textveil.operators.entities import best_per_span, label_category, locate_tagged, to_findings
from textveil.operators.evaluate import category_counts, group_occurrences, inventory, largest, precision_recall, quantiles, values_by_category, verdicts
from textveil.operators.masking import mapping, mask, replacements, rewrite
from textveil.operators.recognise import Null, Service, enabled, recognise
from textveil.operators.recovery import gather, live_mapping, mapping_rows, newest, restore, restore_text
from textveil.operators.settings import load as load_settings
from textveil.operators.tokenize import decode_udf, encode_pair, tokens_udf
from textveil.operators.views import create_findings_view, create_masked_view, create_restored_view, register_functions
from textveil.sources.io import guard, list_files, read_cases, read_settings, read_texts, save_settings, set_aside, write_json, write_masked, write_restored
from textveil.streaming.stream import live_mappings, mask_stream, newest_generation, run_once, window_counts

__all__ = [n for n in dir() if not n.startswith("_")]
