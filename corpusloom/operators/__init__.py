"""DataFrame operators: corpora, dialogues, packing, tokenizers, logic, metrics."""
