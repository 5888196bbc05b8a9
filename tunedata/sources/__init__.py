"""Reading datasets, recipes and logs; writing training sets and recipes."""
