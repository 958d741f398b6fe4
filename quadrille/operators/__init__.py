"""quadrille.operators"""
