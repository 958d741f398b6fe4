"""quadrille.sources"""
