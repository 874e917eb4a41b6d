"""Training-data operators: packing, secret scan, nearest neighbours, near-duplicates, decontamination, chat, classifiers, counts."""
