"""Training-data pipeline operators: quality, decontamination, archives, language, chat,
licences, sharding, near-duplicates and packing.  Nothing else in the library imports this."""
