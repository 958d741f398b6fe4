"""quadrille.streaming"""
