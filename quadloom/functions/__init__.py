"""Terms as columns and the scalar functions on them."""
