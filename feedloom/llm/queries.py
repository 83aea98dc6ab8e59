"""Registered queries of the training-data operators and the SQL that checks them."""

import corpus_pipeline
from feedloom.llm import chat, embeddings, gif, language_id, line_dedup, mixing, packing, secrets, simhash, spelling, substrings, url_filter, vector_codes

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_simhash": simhash.op2,
    "op3_secrets": secrets.op3,
    "op4_mixing": mixing.op4,
    "op5_substrings": substrings.op5,
    "op6_gif": gif.op6,
    "op7_embeddings": embeddings.op7,
    "op8_packing": packing.op8,
    "op9_chat": chat.op9,
    "op10_language_id": language_id.op10,
    "op11_spelling": spelling.op11,
    "op12_url_filter": url_filter.op12,
    "op13_vector_codes": vector_codes.op13,
    "pages_language": language_id.pages,
    "pipeline": corpus_pipeline.run,
}
CHECKS = {
    "op4_mixing": mixing.OP4_SQL, "op9_chat": chat.OP9_SQL, "op11_spelling": spelling.OP11_SQL, "op12_url_filter": url_filter.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL
