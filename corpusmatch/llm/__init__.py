"""Training-data operators: packing, deduplication, filters, models, search and mixing over a text corpus."""
