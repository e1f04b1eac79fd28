"""Training-data operators: one module each, with its thin query and its SQL where SQL can say it."""
