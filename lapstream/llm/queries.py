"""The registered queries of this subpackage, and their SQL where SQL can express them. The entry point adds the pipeline."""

from . import divergence, language, licences, manifest, minhash, mixing, packing, repeats, secrets, toxicity, urls, vectors

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1,
    "op2_toxicity": toxicity.op2,
    "op3_substring_dedup": repeats.op3,
    "op4_mix_sources": mixing.op4,
    "op5_pack_sequences": packing.op5,
    "op6_language_id": language.op6,
    "op7_url_filter": urls.op7,
    "op8_embedding_near_dedup": vectors.op8,
    "op9_nearest_neighbours": vectors.op9,
    "op10_secret_scan": secrets.op10,
    "op11_source_divergence": divergence.op11,
    "op12_licence_scan": licences.op12,
    "op13_merkle_manifest": manifest.op13,
}
ORACLES: dict[str, str] = {"op4_mix_sources": mixing.SQL, "op7_url_filter": urls.SQL, "op11_source_divergence": divergence.SQL, "op12_licence_scan": licences.SQL, "op13_merkle_manifest": manifest.SQL}
