"""Operations on training text, each a Spark job over whole tables."""
