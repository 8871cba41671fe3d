"""Plan building blocks shared by the operators: sessions, cuts, cell pyramids, ordered numbering."""
