"""Training-data operators: near-dedup, token output, decontamination, secrets, quality, language, packing, URLs, chat, fingerprints."""
