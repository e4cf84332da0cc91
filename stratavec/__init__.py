"""stratavec: typed, NA-aware, positional vectors expressed as Spark DataFrame plans."""
