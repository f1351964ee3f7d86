"""Rule packs: plain data that the operators compile to column expressions."""
